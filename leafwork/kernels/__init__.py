"""Kernels over page images: numpy on decoded grey arrays, one page at a time."""

"""Readers of page data: JSON lines, tab-separated recognition output, label and correction files, image lists."""

"""Writers of pages: plain text, JSON lines, hOCR, reports, training manifests."""

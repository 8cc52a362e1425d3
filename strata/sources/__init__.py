"""Storage: the versioned mutation log, files of metadata, and the binary formats."""

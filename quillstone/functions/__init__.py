"""Part of quillstone."""

"""Chat exports, media folders and result tables."""

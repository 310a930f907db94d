"""streaming of skein."""

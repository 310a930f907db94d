"""plans of skein."""

"""Sources (file readers, sampling, preview, sample generators) and sinks."""

"""Where knowledge bases come from and go to."""

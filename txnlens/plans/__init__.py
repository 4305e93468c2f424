"""Session setup, checked broadcasts, the operator catalog and the batch run."""

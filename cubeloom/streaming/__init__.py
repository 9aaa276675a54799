"""Results as they come: rows and chunks without materialising a whole result on the driver."""

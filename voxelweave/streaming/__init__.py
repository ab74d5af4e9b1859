"""Extension: volumes that arrive in a folder, extracted as a stream."""

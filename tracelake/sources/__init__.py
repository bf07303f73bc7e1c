"""Tables, adapters and storage."""

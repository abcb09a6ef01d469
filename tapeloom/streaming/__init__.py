"""The order-book fold over streams of order messages."""

"""Operators over orders and trades: auction, book, replay, verification, labels and features."""

"""Listings, change journals and table storage."""

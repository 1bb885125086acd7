"""Streaming forms of batch operators (same semantics, watermarked)."""

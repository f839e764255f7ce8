"""Operators on facts (gid, ts, datasets) and metadata (gid, latitude, longitude, ...): frames in, frames out."""

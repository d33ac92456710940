"""Readers and writers: event logs, derived blobs, hash manifests, journals, file trees."""

"""Readers and writers of submission files, class lists, manifests and caches."""

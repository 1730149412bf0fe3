"""Readers, writers, paging and sampling."""

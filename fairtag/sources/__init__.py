"""Readers that turn raw tables into the library's models."""

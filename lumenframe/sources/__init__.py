"""Readers of images, specifications and generated scenes."""

"""Watching inputs."""

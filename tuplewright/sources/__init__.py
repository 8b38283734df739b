"""Where data comes from and goes to: log stores, entry files, edge inputs."""

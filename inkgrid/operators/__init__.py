"""DataFrame operators over tokens, regions, lines, fields and operations."""

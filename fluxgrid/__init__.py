"""Spark-native analytics over spatio-temporal stacks: frames, vectors, edges, regions and traces as relations."""

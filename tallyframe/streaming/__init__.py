"""Nothing here is a stream: every operator takes bounded tables. Verbs without windows or sorts also run on streaming frames."""

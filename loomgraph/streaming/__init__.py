"""Change feed, debounce and micro-batch maintenance."""

"""What callers run: the service, the command line, figures."""

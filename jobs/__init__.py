"""Jobs that run on their own: each has a function that takes a session, a command line, and a small config file."""

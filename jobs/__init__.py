"""Jobs to run from a command line or a scheduler: each is a function over a session, plain paths and a small configuration."""

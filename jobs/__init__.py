"""Jobs to run on a cluster: each is a function that takes a session, with a command line and a configuration file."""

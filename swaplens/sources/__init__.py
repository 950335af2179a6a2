"""Tables in and out, and the binding of the test tables."""

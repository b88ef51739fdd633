"""The session and folders of the other tests."""

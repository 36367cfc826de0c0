"""Reading and writing of item relations."""

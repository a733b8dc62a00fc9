"""Movies and tables from files, and back."""

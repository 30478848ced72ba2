"""Reading reviews, sampling them, and writing results."""

"""DataFrame operators. They know no column of the study: names arrive as arguments."""

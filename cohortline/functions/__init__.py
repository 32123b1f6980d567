"""Pure Column helpers: no DataFrame in, no DataFrame out."""

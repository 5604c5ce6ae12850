"""Where tables, truths and other inputs come from."""

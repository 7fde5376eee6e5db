"""Building blocks of physical plans: scratch tables, hot-key joins, ranks."""

"""Building blocks of the plans: joins, sinks, quality rules, sampling."""

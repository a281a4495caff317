"""DataFrame operators: joins, intervals, context windows, scoring, profiles, retrieval, fusion."""

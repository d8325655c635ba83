"""Where rows come from: fetching, robots rules, sitemaps, stores, configuration."""

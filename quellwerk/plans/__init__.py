from quellwerk.plans import answers, compare, corpus, items, search, values  # noqa: F401  register their queries

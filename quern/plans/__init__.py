"""Named queries over the tables of a folder, by topic."""

from quern.plans import history, texts, web

REGISTRY = (web, texts, history)

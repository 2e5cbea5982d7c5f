"""Queries by name: operators applied to the given tables, each with SQL written independently of it."""

from storyloom.plans.registry import Catalog, with_shared
from storyloom.queries import continuity, golden, human, library, names, records, retrieval, runs, scoring, sequence, sources, story, style, text
from storyloom.streaming import chapters, events

streams = Catalog()
streams.queries.update(events.QUERIES | chapters.QUERIES)
streams.oracles.update({name: with_shared(sql) for name, sql in (events.ORACLES | chapters.ORACLES).items()} | {"stream_metrics": with_shared("SELECT book, ch_num, ch_hash, wc, hook_density, pleasure_intensity FROM metrics")})

CATALOGS = (sequence.query, scoring.query, story.query, style.query, text.query, retrieval.query, records.query, sources.query, library.query, names.query, continuity.query, golden.query, human.query, runs.query, streams)

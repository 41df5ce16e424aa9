"""All registered queries."""

from __future__ import annotations

from orbitile.plans import assets, evaluation, ground, places, raster

QUERIES = {**raster.QUERIES, **evaluation.QUERIES, **assets.QUERIES, **places.QUERIES, **ground.QUERIES}


def queries():
    return {name: fn for name, (fn, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}

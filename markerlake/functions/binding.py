"""Names for intermediate columns. A column used twice is written out twice in the plan, so expressions that build on
each other grow with every level; a bound one is evaluated once and then referred to."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(f: Callable[..., Column]) -> Callable[..., Column]:
    """f with its column arguments evaluated once each."""

    @functools.wraps(f)
    def run(*args, **named):
        places = [k for k, a in enumerate(args) if isinstance(a, Column)]
        if not places:
            return f(*args, **named)
        together = F.array(F.struct(*(args[k].alias(f"a{k}") for k in places)))
        return F.get(F.transform(together, lambda s: f(*(s[f"a{k}"] if k in places else a for k, a in enumerate(args)), **named)), F.lit(0))

    return run

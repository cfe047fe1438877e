"""Features and relations from query servers, with failover; the transport is a parameter, so saved answers serve as well.

Retrieval runs on the driver, one query per region or relation; what comes back goes to tables.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from roadloom.operators.features import relation_members

#: (endpoint, query) -> the text of the answer; raises if there is none
Transport = Callable[[str, str], str]


def area_query(ring: Iterable[tuple[float, float]], tags: dict[str, str | None], timeout: int = 300) -> str:
    """All nodes, ways and relations within a ring of (lon, lat) that have one of the tags (any value for None), with geometry."""
    area = " ".join(f"{lat!r} {lon!r}" for lon, lat in ring)
    wanted = "".join(f'nwr["{k}"](poly:"{area}");' if v is None else f'nwr["{k}"="{v}"](poly:"{area}");' for k, v in tags.items())
    return f"[out:json][timeout:{timeout}];({wanted});out geom;"


def relation_query(relation_id: int, timeout: int = 300) -> str:
    return f"[out:json][timeout:{timeout}];relation({int(relation_id)});out geom;"


def fetched(query: str, endpoints: Iterable[str], transport: Transport, tries: int = 2, pause: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """The elements of the first answer: every endpoint is tried `tries` times, waiting pause * attempt after a failure.

    ConnectionError with all that went wrong if none answers.
    """
    wrong = []
    for endpoint in endpoints:
        for attempt in range(1, tries + 1):
            try:
                return json.loads(transport(endpoint, query))["elements"]
            except Exception as e:  # noqa: BLE001  # whatever the transport raises counts as no answer
                wrong.append(f"{endpoint}, try {attempt}: {type(e).__name__}: {e}")
                if pause:
                    sleep(pause * attempt)
    raise ConnectionError("; ".join(wrong) or "no endpoint is given")


def relations(spark: SparkSession, ids: Iterable[int], endpoints: Iterable[str], transport: Transport, tries: int = 4, pause: float = 5.0, **options) -> DataFrame:
    """relation_members() of the relations with these ids."""
    endpoints, answers = list(endpoints), []
    for i in ids:
        own = [e for e in fetched(relation_query(i), endpoints, transport, tries, pause, **options) if e.get("type") == "relation"]
        if not own:
            raise ValueError(f"no relation {i}")
        answers.append((json.dumps(own[0]),))
    return relation_members(spark.createDataFrame(answers, "value string"))

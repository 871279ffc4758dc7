"""Storage paths out of file URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

BUCKET = "agent-documents"


def _decoded(path):
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def path_from_url(url):
    """Object path inside the bucket; plain paths and unknown URLs come back unchanged."""
    marked = F.regexp_extract(url, rf"/object/(?:public|sign|authenticated)/{BUCKET}/([^?]*)", 1)
    after = F.element_at(F.split(url, f"{BUCKET}/"), 2)
    loose = F.regexp_extract(after, r"^([^?]*)", 1)
    has_marker = url.rlike(rf"/object/(?:public|sign|authenticated)/{BUCKET}/")
    return (
        F.when(url.isNull() | (url == ""), None)
        .when(~url.startswith("http"), url)
        .when(has_marker, _decoded(marked))
        .when(url.contains(f"{BUCKET}/"), F.when(url.contains(f"{BUCKET}/"), _decoded(loose)))
        .otherwise(url)
    )


def owned_path(url, agent_id):
    """Path that may be removed for this agent: inside the agent's folder, without ``..`` parts."""
    path_part = F.regexp_extract(url, r"^https?://[^/]*([^?#]*)", 1)
    inner = F.regexp_extract(path_part, rf"/object/(?:public|sign|authenticated)/{BUCKET}/(.+)", 1)
    is_url = url.rlike(r"^https?:")
    path = F.when(is_url, F.when(inner != "", F.url_decode(F.replace(inner, F.lit("+"), F.lit("%2B"))))).otherwise(url)
    safe = path.startswith(F.concat(agent_id.cast("string"), F.lit("/"))) & ~F.array_contains(
        F.split(path, "/"), ".."
    )
    return F.when((url != "") & safe, path)

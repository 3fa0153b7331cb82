"""Outlet identity: many spellings of one outlet to one key.

Edge cases: a null or empty source is ``unknown`` and no aggregator; a host of endings alone keeps its
first one; names that differ in case, spaces and marks only are one outlet.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names under which outlets appear, and those that publish others' reports again.
ALIASES = {
    "ข่าวสด": "khaosod", "มติชนออนไลน์": "matichon", "มติชน": "matichon", "เดลินิวส์": "dailynews", "ไทยรัฐ": "thairath", "ไทยรัฐออนไลน์": "thairath",
    "ผู้จัดการออนไลน์": "mgronline", "ประชาชาติธุรกิจ": "prachachat", "กรุงเทพธุรกิจ": "bangkokbiznews", "คมชัดลึก": "komchadluek", "แนวหน้า": "naewna",
    "บ้านเมือง": "banmuang", "สยามรัฐ": "siamrath", "ไทยโพสต์": "thaipost", "ข่าวช่อง 8": "thaich8", "ช่อง 7": "ch7", "สวพ.fm91": "fm91", "จส.100": "js100",
    "อมรินทร์ ทีวี": "amarintv", "amarin tv": "amarintv", "amarintv": "amarintv", "thai pbs": "thaipbs", "ไทยพีบีเอส": "thaipbs", "tnn thailand": "tnn",
    "tnn ช่อง 16": "tnn", "the bangkok insight": "thebangkokinsight", "the better": "thebetter", "the standard": "thestandard", "the reporters": "thereporters",
    "workpoint today": "workpointtoday", "pptv hd 36": "pptvhd36", "nation tv": "nationtv", "top news": "topnews", "ch7.com": "ch7", "thaiger": "thaiger",
    "ไทยเกอร์": "thaiger", "trueid": "trueid", "sanook": "sanook", "kapook": "kapook", "line today": "line", "msn": "msn",
}
AGGREGATORS = ("msn", "line", "trueid", "kapook", "sanook", "thaitabloid", "facebook", "youtube", "tiktok", "x", "twitter", "instagram", "google", "bing")
# Labels at the end of a host that say nothing about the outlet.
LABELS = ("com", "net", "org", "co", "th", "or", "ac", "go", "in", "me", "tv", "io", "asia", "info", "news", "app", "online", "website")


def outlet_identity(source: Column, aliases: dict[str, str] | None = None, aggregators: tuple[str, ...] = AGGREGATORS) -> Column:
    """struct(key, aggregator): the alias of a name or host, the telling label of a host, else the name without spaces and marks."""
    low = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    table = F.create_map(*[F.lit(x) for pair in (ALIASES if aliases is None else aliases).items() for x in pair])
    # The last label that isn't one of the endings; of endings alone the first one.
    host = F.regexp_extract(F.regexp_replace(low, r"^www\.", ""), rf"([^.]+)(?:\.+(?:{'|'.join(LABELS)}))*\.*$", 1)
    folded = F.regexp_replace(low, r"[\s.\-_\x27\x22()]+", "")
    named = F.when(low.rlike(r"^[a-z0-9][a-z0-9.-]*\.[a-z]{2,}$"), F.coalesce(F.try_element_at(table, host), host)).otherwise(folded)
    key = F.when(low == "", F.lit("unknown")).otherwise(F.coalesce(F.try_element_at(table, low), named))
    return F.struct(key.alias("key"), key.isin(*aggregators).alias("aggregator"))


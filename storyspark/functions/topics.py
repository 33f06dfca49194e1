"""Keyword topic rules (plain substring tests on lower-cased text).

Substring tests are kept as they are, so a short keyword can match inside a
longer word ("ai" in "said"); the first rule that matches wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TOPIC = "General"
UNCLUSTERED_TOPIC = "Unclustered"

# --- fixed values: topic keyword rules, in rule order (must equal the
# --- reference's lists for identical topic assignments) -------------------
TOPIC_RULES: list[tuple[str, list[str]]] = [
    ("Technology", [
        "ai", "artificial intelligence", "machine learning", "software",
        "hardware", "apple", "google", "microsoft", "meta", "amazon",
        "nvidia", "chip", "semiconductor", "robot", "drone", "cyber",
        "hack", "data", "cloud", "startup", "app", "iphone", "android",
        "tesla", "electric vehicle", "ev", "5g", "quantum", "linux",
        "open source", "github", "api", "llm", "gpt", "model",
    ]),
    ("Business & Finance", [
        "stock", "market", "nasdaq", "dow", "s&p", "earnings", "revenue",
        "profit", "loss", "ipo", "acquisition", "merger", "bank", "fed",
        "federal reserve", "inflation", "gdp", "economy", "trade",
        "tariff", "billion", "trillion", "investment", "venture",
        "fund", "hedge", "crypto", "bitcoin", "ethereum", "currency",
        "dollar", "euro", "rate", "interest", "recession",
    ]),
    ("Politics", [
        "president", "prime minister", "parliament", "senate", "congress",
        "election", "vote", "democrat", "republican", "government",
        "minister", "policy", "law", "legislation", "bill", "court",
        "supreme court", "judge", "trump", "biden", "modi", "xi",
        "putin", "nato", "un", "united nations", "sanction", "diplomat",
        "treaty", "protest", "democracy",
    ]),
    ("World News", [
        "war", "attack", "military", "troops", "ukraine", "russia",
        "israel", "gaza", "iran", "china", "north korea", "taiwan",
        "conflict", "ceasefire", "missile", "bomb", "refugee",
        "humanitarian", "crisis", "earthquake", "flood", "disaster",
        "africa", "europe", "asia", "middle east",
    ]),
    ("Science", [
        "research", "study", "scientists", "discovery", "space", "nasa",
        "planet", "star", "galaxy", "climate", "carbon", "fossil",
        "species", "gene", "dna", "brain", "physics", "chemistry",
        "biology", "quantum", "experiment", "university", "journal",
        "nature", "cell", "protein", "virus", "bacteria",
    ]),
    ("Health & Medicine", [
        "health", "hospital", "doctor", "patient", "drug", "vaccine",
        "cancer", "disease", "diabetes", "heart", "mental health",
        "therapy", "surgery", "fda", "clinical trial", "treatment",
        "medicine", "covid", "outbreak", "epidemic", "obesity",
        "nutrition", "diet", "fitness", "sleep",
    ]),
    ("Sports", [
        "football", "soccer", "basketball", "tennis", "cricket",
        "baseball", "rugby", "golf", "olympic", "championship",
        "tournament", "league", "nba", "nfl", "fifa", "premier league",
        "player", "coach", "team", "match", "game", "score", "win",
        "defeat", "final", "cup", "athlete",
    ]),
    ("Entertainment", [
        "movie", "film", "music", "album", "singer", "actor", "actress",
        "celebrity", "award", "oscar", "grammy", "netflix", "streaming",
        "tv show", "series", "book", "novel", "author", "concert",
        "festival", "fashion", "art", "museum", "theatre",
    ]),
    ("Environment", [
        "climate change", "global warming", "emission", "renewable",
        "solar", "wind energy", "fossil fuel", "deforestation",
        "wildlife", "conservation", "ocean", "pollution", "plastic",
        "biodiversity", "endangered", "glacier", "temperature record",
    ]),
]
# --- end of fixed values ---------------------------------------------------


def classify_topic(col, rules=None, default: str = DEFAULT_TOPIC) -> Column:
    """First topic whose keyword occurs in lower(text); ``default`` otherwise.
    Null text is classified as empty text."""
    c = F.lower(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))
    expr = None
    for topic, keywords in (rules or TOPIC_RULES):
        cond = None
        for kw in keywords:
            t = c.contains(kw)
            cond = t if cond is None else (cond | t)
        expr = F.when(cond, F.lit(topic)) if expr is None else expr.when(cond, F.lit(topic))
    return expr.otherwise(F.lit(default))


def topic_sql(text_sql: str, rules=None, default: str = DEFAULT_TOPIC) -> str:
    """The same rule as a SQL CASE (used by the DuckDB oracles)."""
    low = f"lower(coalesce({text_sql}, ''))"
    parts = ["CASE"]
    for topic, keywords in (rules or TOPIC_RULES):
        conds = " OR ".join(
            f"contains({low}, '{kw.replace(chr(39), chr(39) * 2)}')" for kw in keywords)
        parts.append(f" WHEN {conds} THEN '{topic.replace(chr(39), chr(39) * 2)}'")
    parts.append(f" ELSE '{default}' END")
    return "".join(parts)

"""Envelope codec (A3) and export sinks."""

import datetime as dt
import json
import tempfile

from pyspark.sql import functions as F

from storyspark.operators.reports import write_export
from storyspark.sources.envelopes import read_envelopes, typed_payload, write_envelopes


def test_envelope_round_trip_with_typed_payload(spark):
    payload = json.dumps({"url": "https://x.com/a", "url_hash": "h", "duplicate_of": "g",
                          "stage": "simhash", "hamming_distance": 2})
    df = spark.createDataFrame([(7, "article.duplicate", dt.datetime(2024, 1, 1, 12), payload),
                                (8, "article.unique", dt.datetime(2024, 1, 1, 13), "{}")],
                               "id long, t string, ts timestamp_ntz, p string")
    env = write_envelopes(df, F.col("t"), F.col("p"), F.col("id"), F.col("ts"))
    back = read_envelopes(env)
    assert back.count() == 2 and back.where("metadata.version = 1 and metadata.trace_id is not null").count() == 2
    wire = json.loads(env.first().value)
    assert wire["payload"]["stage"] == "simhash" and len(wire["metadata"]["trace_id"]) == 36 and wire["metadata"]["version"] == 1
    dup = typed_payload(back, "article.duplicate").first()
    assert dup.event_id == "7" and dup.data.stage == "simhash" and dup.data.hamming_distance == 2
    assert dup.timestamp.startswith("2024-01-01T12:00:00")


def test_write_export_layout(spark):
    out = tempfile.mkdtemp(prefix="storyspark-export-")
    clusters = spark.createDataFrame(
        [("c1", "Apple unveils a new chip", 2, "active", ["a.com", "b.com"], dt.datetime(2024, 1, 1),
          dt.datetime(2024, 1, 2), 0.5)],
        "id string, label string, article_count long, status string, top_sources array<string>, "
        "created_at timestamp_ntz, last_activity timestamp_ntz, decay_score double")
    arts = spark.createDataFrame(
        [("a1", "c1", "t1", "https://a.com/1", "en", 100, 1.0, dt.datetime(2024, 1, 1), None),
         ("a2", None, "t2", "https://b.com/2", "en", 50, 0.0, dt.datetime(2024, 1, 2), None)],
        "id string, cluster_id string, title string, url string, language string, content_length long, "
        "quality_score double, extracted_at timestamp_ntz, published_at timestamp_ntz")
    write_export(arts, clusters, out)
    c = spark.read.option("header", True).csv(f"{out}/clusters_export").first()
    assert c.topic == "Technology" and c.top_sources == "a.com|b.com" and c.decay_score == "0.5"
    a = {r.article_id: r.topic for r in spark.read.option("header", True).csv(f"{out}/articles_export").collect()}
    assert a == {"a1": "Technology", "a2": "Unclustered"}
    nested = spark.read.json(f"{out}/nested")
    assert nested.where("topic = 'Technology'").count() == 1

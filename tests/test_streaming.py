from pagewright.streaming import ledger

SCHEMA = "book_id string, page_number long, attempt long, returned long, total_tokens long, sent_at timestamp"


def feed(spark, tmp_path, parts):
    for i, rows in enumerate(parts):
        spark.sql("select 1").count()
        spark.createDataFrame(rows, "book_id string, page_number long, attempt long, returned long, total_tokens long, sent_at string").selectExpr(
            "book_id", "page_number", "attempt", "returned", "total_tokens", "cast(sent_at as timestamp) as sent_at"
        ).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def finish(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/c-{name}").start()
    try:
        q.processAllAvailable()
        return df.sparkSession.sql(f"select * from {name}").collect()
    finally:
        q.stop()


def test_repeated_and_late_events(spark, tmp_path):
    parts = [[("b", 1, 1, 1, 10, "2024-01-01 05:00:00"), ("b", 1, 2, 0, None, "2024-01-02 05:00:00")], [("b", 1, 1, 1, 10, "2024-01-01 05:00:00"), ("b", 2, 1, 1, 7, "2024-01-01 09:00:00")]]
    stream = feed(spark, tmp_path, parts)
    got = finish(ledger.totals(stream, "sent_at"), "totals", "update", tmp_path)
    last = {}
    for r in got:
        last[r.start.day] = max(last.get(r.start.day, (0, 0, 0)), (r.requests, r.lost, r.tokens or 0))
    assert last == {1: (2, 0, 17), 2: (1, 1, 0)}


def test_newest_state(spark, tmp_path):
    parts = [[("b", 1, 2, 1, 10, "2024-01-01 05:00:00"), ("b", 2, 1, 0, None, "2024-01-01 05:00:00")], [("b", 1, 1, 1, 5, "2024-01-01 04:00:00"), ("b", 1, 2, 1, 10, "2024-01-01 05:00:00")]]
    got = finish(ledger.newest_state(feed(spark, tmp_path, parts)), "newest", "update", tmp_path)
    final = {}
    for r in got:
        final[r.page_number] = max(final.get(r.page_number, (0,)), (r.requests, r.attempt, r.tokens or 0))
    assert final == {1: (2, 2, 15.0), 2: (1, 1, 0)}

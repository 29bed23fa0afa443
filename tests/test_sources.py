import json
import os

from mkpulse.sources import reports as S
from mkpulse.sources import schemas as SC


def _land(spark, scratch, name, records, schema):
    path = os.path.join(scratch, name)
    os.makedirs(path)
    with open(os.path.join(path, "part-0.json"), "w") as f:
        for r in records:
            f.write(json.dumps(r) + "\n")
    return S.read_landed(spark, path, schema)


def test_search_ads_rows(spark, scratch):
    recs = [
        {"campaign": {"id": 1, "name": "c", "status": "ENABLED", "advertising_channel_type": "SEARCH"},
         "segments": {"date": "2024-01-05", "hour": 0, "device": "MOBILE"},
         "metrics": {"impressions": 10, "clicks": 0, "cost_micros": None, "conversions": 0.0, "average_cpc": 2500000.0}},
        {"campaign": {"id": 1, "name": "c"}, "segments": {"date": "2024-01-06", "hour": 5},
         "metrics": {"impressions": 10, "clicks": 4, "cost_micros": 1500000, "conversions": 1.0}},
    ]
    raw = _land(spark, scratch, "gads", recs, SC.SEARCH_ADS_RAW)
    rows = sorted(S.search_ads_rows(raw).collect(), key=lambda r: r.date)
    assert rows[0].hour == 0 and rows[0].cost == 0.0 and rows[0].conversion_rate == 0.0 and rows[0].average_cpc == 2.5
    assert rows[1].cost == 1.5 and rows[1].conversion_rate == 0.25 and rows[0].ad_group_id is None
    hourly = S.search_ads_report(raw, S.SEARCH_ADS_REPORTS["hourly"], "2024-01-01", "2024-01-31")
    assert sorted(r.hour for r in hourly.collect()) == [0, 5]  # midnight kept
    assert S.search_ads_report(raw, S.SEARCH_ADS_REPORTS["conversions"]).count() == 0


def test_search_console_rows(spark):
    raw = spark.createDataFrame([(["q", "/p"], None, 10, None, 3.5), (["q"], 2, None, 0.2, None)], SC.SEARCH_CONSOLE_RAW)
    r = S.search_console_rows(raw, ["query", "page", "device"], "gsc_query_page").collect()
    assert r[0].device is None and r[0].clicks == 0 and r[1].page is None and r[1].impressions == 0 and r[1].position == 0.0
    assert r[0]._dataset == "gsc_query_page"
    import pytest

    with pytest.raises(ValueError):
        S.search_console_rows(raw, ["a", "b", "c", "d"], "x")


def test_web_report_rows(spark):
    raw = spark.createDataFrame([([("20240105",), ("(not set)",)], [("12",), ("",)])], SC.WEB_REPORT_RAW)
    rep = S.WebReport("t", ("date", "source"), ("sessions", "bounceRate"))
    r = S.web_report_rows(raw, rep).first()
    assert (r.date, r.source, r.sessions, r.bounceRate) == ("20240105", "(not set)", "12", "")


def test_social_insights_and_adsets(spark, scratch):
    recs = [
        {"date_start": "2024-01-05", "impressions": "100", "clicks": "7", "spend": "12.5",
         "actions": [{"action_type": "app_install", "value": "3"}, {"action_type": "mobile_app_install", "value": "2.9"},
                     {"action_type": "link_click", "value": "6"}],
         "action_values": [{"action_type": "purchase", "value": "9.75"}]},
        {"date_start": "2024-01-06", "impressions": "", "actions": None},
        {"date_start": "2024-01-07", "actions": [{"action_type": "mobile_app_install", "value": "0"},
                                                 {"action_type": "app_install", "value": "5"}]},
    ]
    raw = _land(spark, scratch, "meta", recs, SC.SOCIAL_INSIGHTS_RAW)
    r = sorted(S.social_insights_rows(raw, "account", "act_1").collect(), key=lambda x: x.date)
    assert (r[0].app_installs, r[0].link_clicks, r[0].purchase_value, r[0].spend) == (2, 6, 9.75, 12.5)
    assert (r[1].impressions, r[1].app_installs, r[1].reach) == (0, 0, 0)
    assert r[2].app_installs == 0
    ad = [{"id": "1", "daily_budget": None, "targeting": {"geo_locations": {"countries": ["US", "CA"]}}},
          {"id": "2", "daily_budget": "", "targeting": {"geo_locations": {}}},
          {"id": "3", "daily_budget": "0"}, {"id": "4", "daily_budget": "1050"}]
    a = sorted(S.social_adsets(_land(spark, scratch, "adsets", ad, SC.SOCIAL_ADSET_RAW), "act_1").collect(), key=lambda x: x.adset_id)
    assert [x.daily_budget for x in a] == [None, None, 0.0, 10.5]
    assert [x.target_countries for x in a] == ["US,CA", None, None, None]


def test_post_types(spark, scratch):
    recs = [
        {"id": 1, "created_at": "2024-01-05T10:00:00", "in_reply_to_user_id": 9,
         "referenced_tweets": [{"type": "quoted", "id": 3}], "public_metrics": {"like_count": 2}},
        {"id": 2, "created_at": "2024-01-05T11:00:00", "referenced_tweets": [{"type": "retweeted", "id": 3}]},
        {"id": 3, "created_at": "2024-01-05T12:00:00", "referenced_tweets": [{"type": "quoted", "id": 4}], "public_metrics": None},
    ]
    raw = _land(spark, scratch, "posts", recs, SC.POST_RAW)
    r = {x.tweet_id: x for x in S.posts(raw, "u", "n").collect()}
    assert (r["1"].tweet_type, r["2"].tweet_type, r["3"].tweet_type) == ("reply", "original", "quote")
    assert r["1"].likes == 2 and r["3"].likes == 0
    assert S.posts(raw, "u", "n", max_results=2).count() == 2


def test_ad_insights_fallback(spark):
    primary = spark.createDataFrame([], "ad_id string, spend double, campaign_name string, adset_name string, ad_name string")
    per_ad = spark.createDataFrame([("a1", 1.0)], "ad_id string, spend double")
    meta = spark.createDataFrame([("a1", "Ad one", "s1", "c1")], "ad_id string, ad_name string, adset_id string, campaign_id string")
    r = S.ad_insights_with_fallback(primary, per_ad, meta).collect()
    assert len(r) == 1 and r[0].ad_name == "Ad one" and r[0].campaign_name == ""
    prim2 = spark.createDataFrame([("a9", 5.0, "c", "s", "n")], primary.schema)
    assert [x.ad_id for x in S.ad_insights_with_fallback(prim2, per_ad, meta).collect()] == ["a9"]


def test_search_console_batch_mixed_sets(spark):
    raw = spark.createDataFrame([("gsc_queries", ["2024-01-05", "q"], 3, 10, 0.3, 1.0),
                                 ("gsc_page_device", ["/p", "MOBILE"], None, 5, None, None)],
                                "_dataset string, keys array<string>, clicks long, impressions long, ctr double, position double")
    sets = {"gsc_queries": ("date", "query"), "gsc_page_device": ("page", "device")}
    r = {x._dataset: x for x in S.search_console_batch(raw, sets).collect()}
    assert (r["gsc_queries"].date, r["gsc_queries"].query, r["gsc_queries"].page) == ("2024-01-05", "q", None)
    assert (r["gsc_page_device"].page, r["gsc_page_device"].device, r["gsc_page_device"].clicks) == ("/p", "MOBILE", 0)


LINES = [
    '{"campaign": {"id": 1, "name": "a"}, "metrics": {"clicks": 4, "ctr": 0.5}}', '{"campaign": {"id": 2, "name": "b"}, "metri', '',
    '{"campaign": {"id": "two", "name": "c"}, "metrics": {"clicks": "many"}}', '{"campaign": {"name": "d"}}', '[1, 2]', '"text"', '   ',
    '{"campaign": {"id": 3, "name": null}, "unknown": {"x": 1}}', '{}', '{"campaign": 7}', 'null',
]


def _broken(scratch):
    path = os.path.join(scratch, "landed")
    os.makedirs(path)
    with open(os.path.join(path, "part-0.json"), "w") as f:
        f.write("\n".join(LINES) + "\n")
    return path


def test_rejected_records_are_reported(spark, scratch):
    found = S.inspect_landed(spark, _broken(scratch), SC.SEARCH_ADS_RAW, required=["campaign.id"])
    good = S.accepted(found)
    assert good.schema == SC.SEARCH_ADS_RAW
    assert sorted((r.campaign.id, r.campaign.name, r.metrics.clicks if r.metrics else None) for r in good.collect()) == [(1, "a", 4), (3, None, None)]
    bad = {r.record: r.reason for r in S.rejected(found).collect()}
    assert bad == {
        LINES[1]: "malformed", LINES[3]: "wrong type: campaign.id, metrics.clicks", LINES[4]: "missing: campaign.id", LINES[5]: "malformed",
        LINES[6]: "malformed", LINES[9]: "missing: campaign.id", LINES[10]: bad[LINES[10]], LINES[11]: bad[LINES[11]],
    }
    assert bad[LINES[10]].startswith("wrong type") and bad[LINES[11]] in ("malformed", "missing: campaign.id")
    total = S.reject_summary(S.rejected(found)).agg({"records": "sum"}).first()[0]
    assert total + good.count() == len([x for x in LINES if x.strip()])
    assert all(r.file.endswith("part-0.json") for r in S.rejected(found).collect())


def test_quarantine_holds_one_folder_per_batch(spark, scratch):
    path, table = _broken(scratch), os.path.join(scratch, "quarantine")
    for batch in ("2024-01-30", "2024-01-31", "2024-01-30"):  # the first lands twice
        assert S.land(spark, path, SC.SEARCH_ADS_RAW, table, batch, required=["campaign.id"]).count() == 2
    got = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(table)
    assert sorted((str(r["batch"]), r["count"]) for r in got.groupBy("batch").count().collect()) == [("2024-01-30", 8), ("2024-01-31", 8)]
    with open(os.path.join(path, "part-0.json"), "w") as f:
        f.write(LINES[0])
    S.land(spark, path, SC.SEARCH_ADS_RAW, table, "2024-01-31", required=["campaign.id"])  # mended: nothing is left of it
    assert [(str(r["batch"]), r["count"]) for r in spark.read.parquet(table).groupBy("batch").count().collect()] == [("2024-01-30", 8)]


def test_columnar_files_are_checked_for_required_fields(spark, scratch):
    path = os.path.join(scratch, "p")
    spark.createDataFrame([(["q"], 1, 2, 0.5, 1.0), (None, 1, 2, 0.5, 1.0)], SC.SEARCH_CONSOLE_RAW).write.parquet(path)
    found = S.inspect_landed(spark, path, SC.SEARCH_CONSOLE_RAW, "parquet", required=["keys", "clicks"])
    assert S.accepted(found).count() == 1 and [r.reason for r in S.rejected(found).collect()] == ["missing: keys"]

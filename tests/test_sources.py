"""Sources and sinks: envelope decode, typed CSV (FIXTURES F14), write modes."""

import json
import os
import tempfile

import pytest

from revspark.sources import reviews as SR


def _envelope(reviews):
    return {"success": 1, "cursor": "AoJ", "query_summary": {"num_reviews": len(reviews)},
            "reviews": reviews}


REVIEW_A = {"recommendationid": "85", "author": {"steamid": "76561198000000001", "num_games_owned": 3,
            "num_reviews": 1, "playtime_forever": 60, "playtime_last_two_weeks": 0,
            "last_played": 1618826641}, "language": "english", "review": "great 🎮 game",
            "timestamp_created": 1618826641, "timestamp_updated": 1618826641, "voted_up": True,
            "votes_up": 2, "votes_funny": 0, "weighted_vote_score": "0.56", "comment_count": 0,
            "steam_purchase": True, "received_for_free": False, "written_during_early_access": False}
REVIEW_B = dict(REVIEW_A, recommendationid="86", weighted_vote_score=0, language="Français",
                developer_response="thanks")


def test_envelope_decode(spark):
    d = tempfile.mkdtemp(prefix="revspark-test-")
    with open(os.path.join(d, "p1.json"), "w") as fh:
        fh.write(json.dumps(_envelope([REVIEW_A, REVIEW_B])) + "\n")
        fh.write(json.dumps(_envelope([])) + "\n")
    rows = SR.read_flat_reviews(spark, d).orderBy("recommendation_id").collect()
    assert [r.recommendation_id for r in rows] == [85, 86]
    assert rows[0].steam_id == 76561198000000001
    assert rows[0].title == "NA" and rows[0].developer_response == ""
    assert rows[1].language == "french" and rows[1].developer_response == "thanks"
    assert rows[0].review == "great 🎮 game"
    from revspark.operators.flatten import flatten_reviews
    extra = flatten_reviews(SR.read_review_pages(spark, d), extra=True).orderBy("recommendation_id")
    assert [r.weighted_vote_score for r in extra.collect()] == [0.56, 0.0]


def test_csv_broken_rows_f14(spark):
    d = tempfile.mkdtemp(prefix="revspark-test-")
    names = SR.FLAT_REVIEW.fieldNames()
    good = {"title": "t", "appid": "1", "recommendation_id": "85", "steam_id": "9", "num_games_owned": "1", "num_reviews": "1",
            "playtime_forever": "5", "language": "english", "review": '"a\nb ""q"""', "timestamp_created": "7", "voted_up": "true",
            "votes_up": "1", "votes_funny": "0", "comment_count": "0", "steam_purchase": "true", "received_for_free": "false",
            "written_during_early_access": "false", "developer_response": ""}
    line = lambda **kw: ",".join((good | kw)[n] for n in names)
    with open(os.path.join(d, "r.csv"), "w") as fh:
        fh.write("\n".join([",".join(names), line(), ",".join(names), line(recommendation_id="x"), "only one field",
                            line(recommendation_id="86", review="ok"), line(recommendation_id="87") + ",one too many",
                            line(recommendation_id=""), line(recommendation_id="88", voted_up="maybe")]) + "\n")
    rows = SR.read_reviews(spark, d).orderBy("recommendation_id").collect()
    assert [(r.recommendation_id, r.review) for r in rows] == [(85, 'a\nb "q"'), (86, "ok")]
    assert SR.read_reviews(spark, d, with_validity=True).filter("not is_valid").count() == 6
    with pytest.raises(ValueError):
        SR.read_reviews(spark, d, strict=True)


def test_short_row_alone_is_refused(spark):
    d = tempfile.mkdtemp(prefix="revspark-test-")
    with open(os.path.join(d, "r.csv"), "w") as fh:
        fh.write(",".join(SR.FLAT_REVIEW.fieldNames()) + "\ntitle only\n")
    assert SR.read_reviews(spark, d).count() == 0
    with pytest.raises(ValueError):
        SR.read_reviews(spark, d, strict=True)


def test_sentiment_csv(spark):
    d = tempfile.mkdtemp(prefix="revspark-test-")
    with open(os.path.join(d, "s.csv"), "w") as fh:
        fh.write('title,user_review,user_suggestion,votes_up,votes_funny\ng,"a, ""b""",1,3,4\n')
    from revspark.operators.flatten import add_vote_label
    row = add_vote_label(SR.read_sentiment_csv(spark, d)).collect()[0]
    assert row.user_review == 'a, "b"' and row.user_suggestion == 1 and row.up_funny is False


def test_undecodable_rows_are_rejected(spark):
    from revspark.operators.flatten import flatten_reviews
    d = tempfile.mkdtemp(prefix="revspark-test-")
    bad = [dict(REVIEW_A, recommendationid="x1"), dict(REVIEW_A, recommendationid="87", language="klingon"),
           dict(REVIEW_A, recommendationid="99999999999999999999")]
    with open(os.path.join(d, "p.json"), "w") as fh:
        fh.write(json.dumps(_envelope([REVIEW_A, *bad])) + "\n")
    pages = SR.read_review_pages(spark, d)
    assert [r.recommendation_id for r in flatten_reviews(pages).collect()] == [85]
    kept = flatten_reviews(pages, with_validity=True)
    assert sorted(r.reject_reason or "" for r in kept.collect()) == ["", "bad recommendationid", "bad recommendationid", "unknown language"]


def test_read_reviews_strict_and_write_modes(spark):
    from revspark.plans import standins
    d = tempfile.mkdtemp(prefix="revspark-test-")
    out = os.path.join(d, "store")
    flat = standins.flat_reviews(spark, "/root/testdata/sf0.001").limit(20)
    SR.write_reviews(flat, out, mode="new", fmt="csv")
    with pytest.raises(FileExistsError):
        SR.write_reviews(flat, out, mode="new", fmt="csv")
    SR.write_reviews(flat, out, mode="append", fmt="csv")
    back = SR.read_reviews(spark, out, strict=True)
    assert back.count() == 40
    with pytest.raises(FileNotFoundError):
        SR.write_reviews(flat, os.path.join(d, "missing"), mode="append")
    bad = os.path.join(d, "bad")
    os.makedirs(bad)
    with open(os.path.join(bad, "x.csv"), "w") as fh:
        fh.write(",".join(SR.FLAT_REVIEW.fieldNames()) + "\n" + "t,1,notanumber" + ",1" * 15 + "\n")
    with pytest.raises(ValueError):
        SR.read_reviews(spark, bad, strict=True)
    assert SR.read_reviews(spark, bad).count() == 0

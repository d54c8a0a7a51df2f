import pytest

from siltlog.streaming import Channels


@pytest.fixture
def channels(spark, tmp_path):
    return Channels(spark, "file://" + str(tmp_path / "channels"))


def test_ids_skip_one_for_each_publish(channels):
    assert channels.publish("a", ["x", "y"]) == [1, 2]
    assert channels.publish("a", ["z"]) == [4]
    assert channels.publish("ab", [b"\xff"]) == [1]
    assert [(r["msg_id"], bytes(r["payload"])) for r in channels.backlog("a").orderBy("msg_id").collect()] == [(1, b"x"), (2, b"y"), (4, b"z")]
    assert channels.show() == ["a", "ab"]


def test_add_and_empty_messages(channels):
    assert channels.add("n") and not channels.add("n")
    with pytest.raises(ValueError):
        channels.publish("n", ["ok", ""])
    assert channels.backlog("n").count() == 0
    assert channels.publish("new", []) == [] and channels.show() == ["n", "new"]


def test_subscription_gets_what_is_new_and_the_backlog_on_request(channels, tmp_path):
    channels.publish("c", ["1", "2"])
    got, mark = [], "file://" + str(tmp_path / "mark")
    channels.subscribe("c", got.append, previous=True, checkpoint=mark, once=True).awaitTermination()
    assert got == [[(1, b"1"), (2, b"2")]]
    fresh = []
    query = channels.subscribe("c", fresh.append)
    channels.publish("c", ["3"])
    channels.publish("other", ["no"])
    query.processAllAvailable()
    query.stop()
    assert fresh == [[(4, b"3")]]


def test_claims_keep_publishers_apart(channels, monkeypatch):
    """Another publisher comes between the reading of the last id and its claim."""
    other = Channels(channels.spark, channels.root)
    channels.publish("c", ["1"])
    create, met = channels.files.create, []

    def late(p, text):
        if "/ids/" in p and not met:
            met.append(other.publish("c", ["2", "3"]))
        create(p, text)

    monkeypatch.setattr(channels.files, "create", late)
    assert channels.publish("c", ["4"]) == [6] and met == [[3, 4]]
    assert [r["msg_id"] for r in channels.backlog("c").orderBy("msg_id").collect()] == [1, 3, 4, 6]
    assert not other.add("c") and channels.show() == ["c"]


def test_a_long_backlog_comes_in_parts(channels, monkeypatch, tmp_path):
    monkeypatch.setattr("siltlog.streaming.PART", 2)
    channels.publish("c", ["1", "2", "3"])
    got = []
    channels.subscribe("c", got.append, previous=True, checkpoint="file://" + str(tmp_path / "m"), once=True).awaitTermination()
    assert got == [[(1, b"1"), (2, b"2")], [(3, b"3")]]

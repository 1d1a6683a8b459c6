"""Media columns, chat windows, language ID and exact search."""

import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terraloom.llm import chat, language, mpeg, topk


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_media_hold_the_payload(mixed):
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in mpeg.digests(mixed).collect())
    want = Counter()
    for r in mixed.collect():
        data = (r["text"] or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        want[r["doc_id"], len(data), len(padded), sha(padded), zlib.crc32(padded[-64:])] += 1
    assert got == want


def test_equal_texts_have_equal_media(odd):
    by_text = defaultdict(set)
    for r in mpeg.digests(odd).join(odd.select("doc_id", "text"), "doc_id").collect():
        by_text[r["text"]].add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000))
def test_streams_are_read_back(payload):
    payload += bytes(-len(payload) % 64 or 64)
    media = mpeg.write_stream(payload)
    s = mpeg.read_stream(media)
    assert mpeg.payload_of(s) == payload and not s.bad_checksums
    assert s.duration == Fraction(s.samples, s.rate)
    assert all(media[o] == 0xFF and media[o + 1] & 0xE0 == 0xE0 for o in s.offsets)


def test_damage_is_noticed_and_junk_skipped():
    payload = bytes(range(256)) * 40
    media = mpeg.write_stream(payload)
    s = mpeg.read_stream(media)
    at = s.offsets[1]
    broken = media[:at + 10] + bytes([media[at + 10] ^ 1]) + media[at + 11 :]
    assert mpeg.read_stream(broken).bad_checksums == 1
    junk = media[: s.offsets[0]] + b"junk" * 10 + media[s.offsets[0] :]
    again = mpeg.read_stream(junk)
    assert again.skipped >= 40 and len(again.offsets) >= len(s.offsets) - 1


def frame(version, layer, index, rate, mode=3, protected=False, fill=0):
    """A frame by its header fields, with zeros as side information."""
    head = bytes((0xFF, 0xE0 | version << 3 | 4 - layer << 1 | (not protected), index << 4 | rate << 2, mode << 6))
    h = mpeg.header(head)
    body = bytearray(h.size - 4)
    if protected:
        body[:2] = mpeg.crc16(head[2:] + bytes(h.checked)).to_bytes(2, "big")
    return head + bytes(body), h


def test_durations_sum_over_rates():
    a, b = frame(3, 3, 9, 1)[0], frame(3, 3, 9, 0)[0]
    s = mpeg.read_stream(a * 10 + b * 10)
    assert s.duration == Fraction(11520, 48000) + Fraction(11520, 44100) and len(s.offsets) == 20 and s.samples == 23040


def test_checksums_of_layers():
    for version, layer, mode in [(3, 1, 0), (3, 1, 3), (3, 1, 1), (2, 1, 0), (3, 3, 0), (2, 3, 3)]:
        data, h = frame(version, layer, 9, 0, mode, protected=True)
        assert mpeg.read_stream(data * 3).bad_checksums == 0
        broken = data[:6] + bytes([data[6] ^ 1]) + data[7:]
        assert mpeg.read_stream(broken * 3).bad_checksums == 3


def test_tables_that_are_cut_short():
    data, h = frame(3, 3, 1, 2)  # a frame of 144 bytes
    small, low = frame(2, 3, 1, 1)  # and one of 24
    assert len(small) == 24 and low.size == 24
    for at in (36,):
        vbri = bytearray(frame(2, 3, 2, 1)[0])
        vbri[at : at + 4] = b"VBRI"
        assert len(vbri) == 48 and mpeg.read_stream(bytes(vbri) * 2).table == {}
    whole = bytearray(data)
    whole[36:40] = b"VBRI"
    whole[46:62] = (1000).to_bytes(4, "big") + (7).to_bytes(4, "big") + (2).to_bytes(2, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + bytes(2)
    whole[62:66] = (5).to_bytes(2, "big") + (6).to_bytes(2, "big")
    assert mpeg.read_stream(bytes(whole) + data).table == {"kind": "VBRI", "frames": 7, "bytes": 1000, "seek": [15, 18]}


def test_tags_of_all_versions():
    audio = frame(3, 3, 9, 1)[0] * 2
    old = b"TT2" + (3).to_bytes(3, "big") + b"\0ab"
    assert mpeg.read_stream(b"ID3\x02\0\0" + mpeg._syncsafe(len(old)) + old + audio).tags["TT2"] == b"\0ab"
    new = mpeg._tag_frame(b"TIT2", b"\0abc")
    foot = mpeg.read_stream(b"ID3\x04\0\x10" + mpeg._syncsafe(len(new)) + new + b"3DI\x04\0\x10" + mpeg._syncsafe(len(new)) + audio)
    assert foot.tags["TIT2"] == b"\0abc" and foot.skipped == 0 and len(foot.offsets) == 2
    extended = (6).to_bytes(4, "big") + bytes(6) + b"TIT2" + (4).to_bytes(4, "big") + b"\0\0" + b"\0abc"
    assert mpeg.read_stream(b"ID3\x03\0\x40" + mpeg._syncsafe(len(extended)) + extended + audio).tags["TIT2"] == b"\0abc"


def id3(version, frames, flags=0):
    return b"ID3" + bytes((version, 0, flags)) + mpeg._syncsafe(len(frames)) + frames


def test_unsynchronised_tags():
    audio, value = frame(3, 3, 9, 1)[0] * 2, b"\1\xff\xfea\xff\xe0\xff\0\xff"
    stored = value.replace(b"\xff\0", b"\xff\0\0").replace(b"\xff\xe0", b"\xff\0\xe0").replace(b"\xff\xfe", b"\xff\0\xfe")
    old = b"TIT2" + len(value).to_bytes(4, "big") + b"\0\0" + stored + b"\0" + b"TPE1" + (2).to_bytes(4, "big") + b"\0\0\0x"
    s = mpeg.read_stream(id3(3, old, 0x80) + audio)
    assert s.tags == {"TIT2": value, "TPE1": b"\0x"} and s.skipped == 0 and len(s.offsets) == 2
    new = b"TIT2" + mpeg._syncsafe(len(stored) + 5) + b"\0\x03" + mpeg._syncsafe(len(value)) + stored + b"\0" + b"TPE1" + mpeg._syncsafe(3) + b"\0\0\0\xff\0"
    s = mpeg.read_stream(id3(4, new, 0x80) + audio)
    assert s.tags == {"TIT2": value, "TPE1": b"\0\xff\0"} and s.skipped == 0


def test_tags_that_follow_one_another_and_stand_between_frames():
    audio = frame(3, 3, 9, 1)[0]
    tag = lambda name, value: id3(4, mpeg._tag_frame(name, value))
    data = tag(b"TIT2", b"\0a") + tag(b"TPE1", b"\0b") + audio * 3 + tag(b"TIT2", b"\0c") + audio + tag(b"TALB", b"\0d")
    s = mpeg.read_stream(data)
    assert s.tags == {"TIT2": b"\0c", "TPE1": b"\0b", "TALB": b"\0d"} and s.skipped == 0 and len(s.offsets) == 4
    assert mpeg.read_stream(b"ID3\x04\0\0\xff\0\0\0" + audio * 2).skipped == 10


def test_frames_of_free_format():
    for version, layer, size in [(3, 3, 500), (3, 2, 311), (3, 1, 400), (2, 3, 200)]:
        head = bytes((0xFF, 0xE1 | version << 3 | 4 - layer << 1, 1 << 2, 0xC0))
        padded = head[:2] + bytes((head[2] | 2,)) + head[3:]
        plain, longer = head + bytes(size - 4), padded + bytes(size - 4 + (4 if layer == 1 else 1))
        for frames in ([plain] * 3, [plain, longer, plain], [longer, longer, plain, plain, longer]):
            s = mpeg.read_stream(b"junk" + b"".join(frames))
            assert len(s.offsets) == len(frames) and s.skipped == 4
            assert s.offsets == [4 + sum(map(len, frames[:i])) for i in range(len(frames))]
            assert s.duration == Fraction(len(frames) * mpeg.header(head, size).samples, s.rate)
    assert mpeg.read_stream(plain).offsets == []  # a lone one tells no size


def test_delay_and_padding_of_the_encoder_are_not_heard():
    first = bytearray(frame(3, 3, 9, 1)[0])
    first[21:25], first[25:29] = b"Info", (15).to_bytes(4, "big")
    first[21 + 120 : 21 + 129] = b"LAME3.100"
    first[21 + 120 + 21 : 21 + 120 + 24] = (576 << 12 | 1000).to_bytes(3, "big")
    s = mpeg.read_stream(bytes(first) + frame(3, 3, 9, 1)[0] * 5)
    assert (s.table["encoder"], s.table["delay"], s.table["padding"]) == ("LAME3.100", 576, 1000)
    assert s.duration == Fraction(5 * 1152, 48000) and s.heard == Fraction(5 * 1152 - 1576, 48000)


def plain_frames(media):
    """Offsets of the audio frames of one of our streams, by the bits of its headers only."""
    size = 0
    for x in media[6:10]:
        size = size * 128 + x
    at, out = 10 + size, []
    rates = [None, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    while at < len(media) - 128:
        bits = f"{int.from_bytes(media[at:at + 4], 'big'):032b}"
        assert bits[:11] == "1" * 11 and bits[11:13] == "11" and bits[13:15] == "01" and bits[20:22] == "01" and bits[24:26] == "11"
        out.append((at, rates[int(bits[16:20], 2)]))
        at += 1152 // 8 * out[-1][1] * 1000 // 48000 + int(bits[22])
    assert at == len(media) - 128
    return out[1:], int.from_bytes(media[out[0][0] + 31 : out[0][0] + 35], "big")


def test_features_by_another_reader(odd):
    media = {(r["doc_id"], bytes(r["media"])) for r in mpeg.store(odd).collect()}
    got = {(r["doc_id"], r["media_bytes"], r["media_sha256"], r["feature"]) for r in mpeg.digests(odd).collect()}
    want = set()
    for i, m in media:
        frames, told = plain_frames(m)
        rates = ",".join(f"{k}x{n}" for k, n in sorted(Counter(k for _, k in frames).items()))
        seek = zlib.crc32(b"".join(at.to_bytes(8, "little") for at, _ in frames))
        play = Fraction(len(frames) * 1152, 48000)
        want.add((i, len(m), sha(m), f"duration={play.numerator}/{play.denominator};frames={len(frames)};table={told};kbps={rates};seek_crc32={seek}"))
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=60), st.sampled_from([b"\xff\xfb\x04\xc0", b"ID3\x03\0\x80\0\0\0\x14", b"ID3", b"\xff\xfb", b"\xff\xf3\x20", b"VBRI", b"Xing\0\0\0\x0f", b"TAG", *(frame(*f)[0] for f in ((3, 3, 1, 1), (2, 3, 2, 1), (3, 1, 3, 0), (0, 2, 1, 2)))])), max_size=12))
def test_any_bytes_can_be_read(parts):
    data = b"".join(parts)
    s = mpeg.read_stream(data)
    assert s.duration >= 0 and all(0 <= o < len(data) for o in s.offsets) and s.skipped <= len(data)
    assert mpeg.read_stream(data[: len(data) // 2]).duration >= 0


def test_stored_media_can_be_read_as_columns(odd):
    rows = mpeg.read(mpeg.store(odd)).collect()
    assert len(rows) == odd.count()
    assert all(r["bad_checksums"] == 0 and r["offsets"] and r["duration"] > 0 for r in rows)


# --- chat -------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def brute_chat(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()), len(loss), sha(loss.encode()))
    return out


def check_chat(spark, rows, **kw):
    df = spark.createDataFrame(rows, TURNS)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chat.windows(df, **kw)).collect()}
    assert got == brute_chat(rows)


def test_chat_windows_lose_nothing(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_chat(spark, rows)
    check_chat(spark, rows, budget=64, history=32)


def test_chat_cases(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "system", "be brief"), *((1, i, ("user", "assistant")[i % 2], f"turn {i} " * 30) for i in range(1, 700))]
    rows += [(2, None, "user", None), (2, 0, None, "x"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (None, 0, "assistant", r"<\\/s> [\INST] <"), (3, 5, "user", ""), (4, 0, "assistant", "long " * 5000), (5, 0, " [/INST]", "<s>"), (5, 1, "system", "late")]
    check_chat(spark, rows)
    check_chat(spark, rows, budget=100, history=40)


def test_chat_takes_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(c, i, ("user", "assistant")[i % 2], f"turn {i} of {c}") for c in (1, 2) for i in range(5)]
    df = spark.createDataFrame(rows, TURNS)
    wide = df.select("*", *(F.lit(7).alias(c) for c in ("idx", "block", "tokens", "sys", "same", "window", "before", "entry", "loss")))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chat.windows(wide)).collect()}
    assert got == brute_chat(rows)


def test_chat_windows_keep_budget_and_system_turn(spark):
    rows = [(1, 0, "system", "be brief"), *((1, i, ("user", "assistant")[i % 2], f"turn {i} " * 10) for i in range(1, 200))]
    made = chat.windows(spark.createDataFrame(rows, TURNS), budget=400, history=80).orderBy("block", "window").collect()
    assert len(made) > 5
    for w in made:
        turns = chat.parse(w["text"])
        assert turns[0] == ("system", "be brief")
    assert any(w["repeated"] > 1 for w in made)


def brute_windows(rows, budget, history):
    """Turns of each window of one conversation, by one pass over all of it."""
    from terraloom.llm.vocab import BYTE_BPE, tokenizer

    coder = tokenizer(BYTE_BPE)
    size = lambda r, t: len(coder.encode(chat.format_turn(r, t)[0], add_special_tokens=False).ids)
    turns = [(r, t) for _, _, r, t in sorted(rows, key=lambda x: x[1:])]
    n, system = [size(*x) for x in turns], next((x for x in turns if x[0] == "system"), None)
    at, out, said_at = 0, [], turns.index(system) if system else None
    while at < len(turns):
        lo, said = at, system is not None and said_at <= at
        s = size(*system) if said else 0
        while lo and sum(n[lo - 1 : at]) <= min(history, budget - s - n[at]):
            lo -= 1
        lead = [system] if said and system not in turns[lo : at + 1] else []
        end = at + 1
        while end < len(turns) and sum(n[lo : end + 1]) + (s if lead else 0) <= budget:
            end += 1
        out.append((lead + turns[lo:end], len(lead) + at - lo))
        at = end
    return out


def test_a_system_turn_heads_no_earlier_turn_and_passes_the_budget_by_itself_at_most(spark):
    from terraloom.llm.vocab import BYTE_BPE, tokenizer

    count = lambda text: len(tokenizer(BYTE_BPE).encode(text, add_special_tokens=False).ids)
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} " * 9) for i in range(60)] + [(1, 60, "system", "rule " * 90), (1, 61, "user", "word " * 150), *((1, i, ("assistant", "user")[i % 2], f"turn {i} " * 9) for i in range(62, 120))]
    made = chat.windows(spark.createDataFrame(rows, TURNS), budget=300, history=40).orderBy("block", "window").collect()
    assert [(chat.parse(w["text"]), w["repeated"]) for w in made] == brute_windows(rows, 300, 40)
    seen = 0
    for w in made:
        turns = chat.parse(w["text"])
        assert (turns[0][0] == "system") <= (seen >= 60)
        seen += len(turns) - w["repeated"]
        assert count(w["text"]) <= 300 + count(chat.format_turn("system", "rule " * 90)[0])


def test_chat_of_an_empty_table(spark):
    assert chat.digests(chat.windows(spark.createDataFrame([], TURNS))).count() == 0


def test_every_formatted_turn_has_the_least_tokens_that_blocks_reckon_with():
    from terraloom.llm.vocab import BYTE_BPE, tokenizer

    assert len(tokenizer(BYTE_BPE).encode(chat.format_turn("", "")[0], add_special_tokens=False).ids) >= chat.LEAST_TOKENS


@pytest.mark.parametrize(("budget", "history"), [(2048, 256), (300, 80), (64, 32)])
def test_chat_windows_are_those_of_one_pass(spark, budget, history):
    from terraloom.llm.vocab import BYTE_BPE, tokenizer

    rows = [(1, 0, "system", "Отвечай кратко и вежливо 漢字"), *((1, i * (1 + i % 3), ("user", "assistant")[i % 2], f"turn {i} " * (i * 7 % 11)) for i in range(1, 900))]
    got = chat.windows(spark.createDataFrame(rows, TURNS), budget, history).orderBy("block", "window").collect()
    assert [(chat.parse(w["text"]), w["repeated"]) for w in got] == brute_windows(rows, budget, history)
    assert len({w["block"] for w in got}) > 2
    if budget >= 300:
        assert all(len(tokenizer(BYTE_BPE).encode(w["text"], add_special_tokens=False).ids) <= budget for w in got)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/s[]INST\\ \n", max_size=40), st.text(alphabet="<>/s[]INST\\ u", max_size=10))
def test_escapes_are_reversible(text, role):
    formatted, _ = chat.format_turn(role, text)
    assert chat.parse(formatted + formatted) == [(role, text)] * 2


# --- language ---------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(docs):
    rows = language.evaluated(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    told = [r for r in rows if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert sum(r["lang"] == r["lang_pred"] for r in told) / len(told) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_cases(odd, empty, docs):
    by_id = {r["doc_id"]: r for r in language.evaluated(odd).collect()}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1, 2, 3, 14))
    assert language.evaluated(empty).count() == 0
    unlabelled = docs.withColumn("lang", docs["lang"].substr(100, 1)).where("false").unionByName(docs.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars"))
    assert {r["lang_pred"] for r in language.evaluated(unlabelled).collect()} == {"und"}
    assert set(language.accepted(odd).columns) == set(odd.columns)


def test_language_keeps_clean_documents(docs):
    kept = {r["doc_id"] for r in language.accepted(docs).select("doc_id").collect()}
    clean = {r["doc_id"] for r in docs.where("lang is not null and length(text) > 200").collect()}
    assert len(clean & kept) >= 0.99 * len(clean)


UNLEARNED = {
    "it": "Il governo ha annunciato oggi una nuova legge che dovrebbe aiutare le famiglie con bambini piccoli e quelle delle grandi città",
    "nl": "De regering heeft vandaag een nieuwe wet aangekondigd die gezinnen met kleine kinderen moet helpen om in de grote steden te wonen",
    "pl": "Rząd ogłosił dzisiaj nową ustawę która ma pomóc rodzinom z małymi dziećmi mieszkającym w wielkich miastach naszego kraju",
    "ru": "Правительство объявило сегодня о новом законе который должен помочь семьям с маленькими детьми живущим в больших городах",
    "fi": "Hallitus ilmoitti tänään uudesta laista jonka pitäisi auttaa perheitä joissa on pieniä lapsia ja jotka asuvat suurissa kaupungeissa",
    "tr": "Hükümet bugün küçük çocukları olan ailelere ve büyük şehirlerde yaşayanlara yardım etmesi gereken yeni bir yasa açıkladı",
}


def test_unlearned_languages_and_random_letters_go_and_labelled_documents_stay(spark, docs):
    rng = np.random.default_rng(5)
    random = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), size=n)) for n in (60, 200, 1000, 5000)]
    strange = spark.createDataFrame([(-1 - i, t) for i, t in enumerate([*UNLEARNED.values(), *random])], "doc_id long, text string")
    kept = [r["doc_id"] for r in language.accepted(docs.unionByName(strange, allowMissingColumns=True)).select("doc_id").collect()]
    labelled = [r["doc_id"] for r in docs.where("lang is not null and text is not null").select("doc_id", "text").collect() if language.has_letter(r["text"])]
    assert not [i for i in kept if i < 0]
    assert sorted(kept) == sorted(labelled)


def test_features_keep_8192_buckets(docs):
    model = language.train(docs.where(~language.held_out()))
    assert model.weights.shape[0] == model.profiles.shape[0] == 8192
    assert all(len(np.unique(model.weights[lo : lo + 4096, 0])) > 1000 for lo in (0, 4096))


# --- exact search -----------------------------------------------------------------------------------------


def brute_top(rows, k=20):
    v = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            v[i] = np.floor(64 * np.array(e, float)).astype(np.int64)
    out = set()
    for q, x in v.items():
        if q % 20 == 0:
            scores = sorted((-int(x[: len(c)] @ c[: len(x)]), i) for i, c in v.items() if i != q)[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)}
    return out


def test_top_k(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = topk.top_k(df).collect()
    assert {tuple(r) for r in got} == brute_top([(r["vec_id"], r["embedding"]) for r in df.collect()]) and len(got) == len(set(got))


def test_top_k_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(90)]
    rows += [(500, None), (520, [1.0, None] + [0.0] * 6), (540, [float("nan")] * 8), (None, [1.0] * 8), (560, [float("inf")] * 8), (580, [0.0] * 8), (20, [rows[20][1]][0])]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<double>, label int")
    got = topk.top_k(df).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == brute_top(rows) and len(got) == len(set(got))
    few = df.where("vec_id < 10")
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(few).collect()} == brute_top([r for r in rows if r[0] is not None and r[0] < 10])
    assert topk.top_k(df.where("false")).count() == 0


def test_top_k_of_several_shards_and_pivots(spark, monkeypatch):
    """Salted shards of one pivot, several pivots, vectors of several lengths, a clashing column."""
    monkeypatch.setattr(topk, "SHARD", 32)
    monkeypatch.setattr(topk, "PIVOTS", 5)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 10)) * 2
    rows = [(i, [float(x) for x in (centres[i % 6] + 0.2 * rng.normal(size=10))[: 10 - i % 2]]) for i in range(400)]
    df = spark.createDataFrame([(i, e, "x", 1.5, 3) for i, e in rows], "vec_id long, embedding array<double>, uid string, v double, shard int")
    got = topk.top_k(df).collect()
    wide = [(i, e + [0.0] * (10 - len(e))) for i, e in rows]
    assert {tuple(r) for r in got} == brute_top(wide) and len(got) == len(set(got))


def test_bounds_avoid_products_in_clusters():
    """Best-first search computes few products among clustered vectors, and finds what brute force finds."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 32)) * 60
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * 3)
    root, share = topk.build_tree(x, np.arange(4000), page=32), []
    for q in x[:50]:
        seen = []
        uids, scores = topk.search(root, q, 20, seen=seen)
        all_scores = x @ q
        assert uids.tolist() == np.lexsort((np.arange(4000), -all_scores))[:20].tolist() and (scores == all_scores[uids]).all()
        share.append(sum(seen) / 4000)
    assert np.mean(share) < 0.2


def plain_prediction(model, text):
    """Family, votes and score of a text, one n-gram at a time."""
    data = (" " + text.lower() + "   ").encode()
    data = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in data)
    seen = Counter()
    for n, k in ((2, 2654435761), (3, 2246822519), (4, 3266489917)):
        for i in range(len(data) - n + 1):
            seen[int.from_bytes(data[i : i + n], "big") * k % 2**32 >> 32 - (language.BUCKETS.bit_length() - 1)] += 1
    length = sum(seen.values()) ** 0.5
    x = {b: c**0.5 / length for b, c in seen.items()}
    margins = [sum(v * float(model.weights[b, m]) for b, v in x.items()) for m in range(model.weights.shape[1])]
    sure = lambda m: 1 / (1 + np.exp(-4 * m))
    n = len(model.families)
    family = max(range(n), key=lambda f: margins[f])
    languages, votes, won = model.families[family], Counter(), defaultdict(list)
    for (f, a, b), m in zip(model.duels, margins[n:], strict=True):
        if f == family:
            votes[a if m >= 0 else b] += 1 + 1e-3 * np.tanh(abs(m))
            won[a].append(m)
            won[b].append(-m)
    best = max(range(len(languages)), key=lambda i: (votes[i], -i))
    score = (1.0 if n == 1 else sure(margins[family])) * (sure(min(won[best])) if won[best] else 1.0)
    blanks = set(language._BLANKS)
    total = sum(v * v for b, v in x.items() if b not in blanks)
    told = [sum(v * v / total * float(model.profiles[b, c]) for b, v in x.items() if b not in blanks) for c in range(len(model.least))]
    over = max(t - float(m) for t, m in zip(told, model.least, strict=True))
    return languages[best], min(score, 1 / (1 + (1 / language.LEAST_SCORE - 1) * np.exp(-4 * over)))


def test_predictions_are_votes_within_the_family(docs):
    model = language.train(docs.where(~language.held_out()))
    assert len(model.families) >= 2 and len(model.duels) >= 1
    said = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in language.evaluated(docs).join(docs.select("doc_id", "text"), "doc_id").collect()}
    tried = 0
    for (_, text), (lang, score) in said.items():
        if text and len(text) < 600 and language.has_letter(text):
            want, sure = plain_prediction(model, text)
            assert lang == want and abs(score - sure) < 1e-3
            tried += 1
    assert tried >= 20


def test_families_of_labels():
    for labels in (("en", "EN", "eng", "en-US", "en_GB", "de-AT", "ger"), ("hi", "mr-IN", "urd"), ("id", "msa"), ("lt", "lv-LV"), ("xx-A", "XX", "xx_B")):
        assert len({language.family_of(x) for x in labels}) == 1
    assert len({language.family_of(x) for x in ("en", "pt-BR", "RU", "fin", "tr", "lt", "hin", "fa", "ar", "xx", "")}) == 11
    assert all(language.family_of(three) == language.FAMILY_OF[two] for three, two in language.THREE.items())


def test_labels_with_regions_meet_in_duels(spark, docs):
    tagged = docs.withColumn("lang", F.when(F.col("lang") == "en", F.when(F.col("doc_id") % 2 == 0, "en-US").otherwise("EN")).otherwise(F.col("lang")))
    model = language.train(tagged)
    family = next(i for i, members in enumerate(model.families) if "en-US" in members)
    assert "EN" in model.families[family]
    assert any(f == family and {model.families[f][a], model.families[f][b]} == {"EN", "en-US"} for f, a, b in model.duels)
    known = {language.family_of(x) for x in ("en", "EN")}
    told = [r for r in language.predict(tagged.where("lang in ('EN', 'en-US')"), model, "lang").collect() if r["lang_pred"] != "und"]
    assert sum(language.family_of(r["lang_pred"]) in known for r in told) >= 0.9 * len(told) > 0


def test_only_the_most_frequent_labels_are_learned(docs):
    most = [r["lang"] for r in docs.where("lang is not null").groupBy("lang").count().orderBy("count", ascending=False).limit(2).collect()]
    model = language.train(docs, languages=2)
    assert sorted(x for f in model.families for x in f) == sorted(most)


@pytest.mark.parametrize("run", [mpeg.digests])
def test_empty_tables(empty, run, spark):
    assert run(empty).count() == 0
    assert chat.digests(chat.windows(spark.createDataFrame([], TURNS))).count() == 0

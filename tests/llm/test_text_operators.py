"""Secrets, PII, audio, pieces, token blocks and chat: pure parts against brute force, edge cases through Spark."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quillmesh.llm import _chars, audio, bytebpe, chat, pfor, pieces, pii, secrets

SCHEMA = "doc_id bigint, text string, spans int, pii int, nbest int, tensors int, LANG_PRED int"
LONG = "word " * 40_000


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, very long, repeated and clashing rows."""
    rows = [(1, None), (2, ""), (3, LONG), (4, "same"), (4, "same"), (5, "same"), (None, "no id"), (6, 'token = "0123456789abcdef0123" x@y.org')]
    return spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in rows], SCHEMA)


def brute_base(text):
    import re

    out = [(m.start(), m.end(), "assign") for m in re.finditer(secrets.ASSIGN.pattern, text, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    return out + [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]


def test_secret_base_spans_equal_the_plain_patterns():
    r = random.Random(1)
    bits = ["token", "=", " ", '"', "AKIA", "ABCDEFGHIJ012345", "0123456789abcdef", "API_KEY", ":", "é", "\n", "abcdefghijklmnop/+", "password", "ſecret"]
    for _ in range(400):
        t = "".join(r.choices(bits, k=14))
        assert sorted(secrets.base_spans(t)) == sorted(brute_base(t))


def test_weak_parts_need_their_complement():
    weak = "Zx9Qw3Er7Ty1Ui5Op8As"
    assert secrets.scan_text(weak)[0] == []
    near, links = secrets.scan_text(f"client_id: bob77 then {weak} at https://vault.example.com:8200/x")
    assert [k for _, _, k in near] == ["identifier", "random", "endpoint"] and len(links) == 1
    assert secrets.scan_text(f"client_id: bob77 {'x ' * 200} {weak}")[0] == []
    assert secrets.scan_text(f"client_id: bob77\n\n{weak}")[0] == []
    text = f"client_id: bob77 {weak}"
    assert secrets.redact_text(text, secrets.scan_text(text)[0]) == "client_id: <secret> <secret>"


def test_endpoints_meet_either_member_and_stand_for_an_identifier():
    weak, url = "Zx9Qw3Er7Ty1Ui5Op8As", "https://vault.example.com:8200"
    far = f"client_id: bob77 {'x ' * 80}{weak} {'x ' * 80}{url}"
    spans, links = secrets.scan_text(far)
    assert [k for *_, k in spans] == ["identifier", "random", "endpoint"] and len(links) == 1 and links[0][2][2] == "endpoint"
    spans, links = secrets.scan_text(f"{url}/x with {weak}")
    assert [k for *_, k in spans] == ["endpoint", "random"] and links[0][0] is None
    assert secrets.redact_text(f"{url} {weak}", secrets.scan_text(f"{url} {weak}")[0]) == f"{url} <secret>"
    assert secrets.scan_text(f"{url}\n\n{weak}")[0] == [] and secrets.scan_text(f"{url}/Zx9Qw3Er7Ty1Ui5Op8As")[0] == []


def test_long_identifiers_and_schemes_are_whole():
    weak, name, scheme = "Zx9Qw3Er7Ty1Ui5Op8As", "u" * 500, "g" * 40
    text = f"client_id: {name} {weak} {scheme}://h.example 7+x://y 1://z a://b ://c"
    spans, links = secrets.scan_text(text)
    assert [text[s:e] for s, e, _ in spans] == [name, weak, f"{scheme}://h.example"] and len(links) == 1
    assert [text[s:e] for s, e, _ in secrets.endpoints(text)] == [f"{scheme}://h.example"]
    assert secrets.redact_text(text, spans).startswith(f"client_id: <secret> <secret> {scheme}://")
    assert [x[:2] for x in secrets.endpoints("go ab://c:70000/d x+y://e://f")] == [(3, 15), (18, 25)]
    assert list(secrets.endpoints("a" * 200_000)) == [] and len(list(secrets.endpoints("a" * 200_000 + "://b"))) == 1


def test_pii_base_spans():
    import re

    r = random.Random(2)
    bits = ["a@b.co", ".", "@", "x-y", "1.2.3.4", "256", "4111 1111 1111 1111", "+1 (555) 010-9999", " ", "\n", "7", "é", "._x@y.zz"]
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(500):
        t = "".join(r.choices(bits, k=8))
        got = pii.base_spans(t)
        assert [(s, e) for s, e, k in got if k == "email"] == [m.span() for m in email.finditer(t)]
        assert [(s, e) for s, e, k in got if k == "ip"] == [m.span() for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    assert [k for *_, k in pii.base_spans("4111 1111 1111 1111 and 4111 1111 1111 1112")] == ["card"]


def test_field_decodes_jointly_and_exactly():
    w = pii.trained()
    r = random.Random(5)
    right = 0
    for _ in range(100):
        text, before, truth = pii._compose(r)
        got = pii.decode(text, before, w)
        tokens = pii._tokens(text)
        segments = pii._segments(text, tokens, before)
        # every segmentation's score by plain recursion over (tokens, last type); the decoded one must be the best
        best = {(0, 0): 0.0}
        for j in range(len(tokens)):
            for k in range(len(pii.LABELS)):
                ways = [best[j, k]] if (j, k) in best else []
                ways += [best[i, last] + pii._score(w, k, f) + pii._after(w, last, k) for i, f in segments[j] for last in range(len(pii.LABELS)) if k and (i, last) in best]
                if ways:
                    best[j + 1, k] = max(ways)
        score, last = 0.0, 0
        for s, e, k in got:
            score += pii._after(w, last, k) + next(pii._score(w, k, f) for j, here in enumerate(segments) for i, f in here if tokens[i][0] == s and tokens[j][1] == e)
            last = k
        assert abs(score - max(x for (j, _), x in best.items() if j == len(tokens))) < 1e-9
        right += got == truth
    assert right >= 90
    base, found = pii.find("call ssn 123-45-6789 today")
    assert not base and [k for *_, k in found] == ["ssn"]
    assert pii.find("the year 2024-01-02 was fine, 12345678 items")[1] == []


def test_gradient_is_that_of_the_likelihood():
    text, before, truth = next(x for x in (pii._compose(random.Random(s)) for s in range(99)) if len(x[2]) > 1)
    w = {k: 0.1 * v for k, v in pii.trained().items()}
    into = {}
    pii._gradient(text, before, truth, w, into)

    def likelihood(w):
        tokens, n = pii._tokens(text), len(pii.LABELS)
        segments = pii._segments(text, tokens, before)
        total = {(0, 0): 1.0}
        for j in range(len(tokens)):
            for k in range(n):
                total[j + 1, k] = total.get((j, k), 0) + sum(total.get((i, last), 0) * np.exp(pii._score(w, k, f) + pii._after(w, last, k)) for i, f in segments[j] for last in range(n) if k)
        score, last = 0.0, 0
        for s, e, k in truth:
            score += pii._after(w, last, k) + next(pii._score(w, k, f) for j, here in enumerate(segments) for i, f in here if tokens[i][0] == s and tokens[j][1] == e)
            last = k
        return score - np.log(sum(x for (j, _), x in total.items() if j == len(tokens)))

    for k in [*list(into)[:12], (3, "after=ssn"), (1, "after=")]:
        up, down = ({**w, k: w.get(k, 0.0) + d} for d in (1e-5, -1e-5))
        assert abs((likelihood(up) - likelihood(down)) / 2e-5 - into.get(k, 0.0)) < 2e-2, k  # terms under 1e-3 are left out


def test_many_entities_in_a_row_are_all_found():
    r = random.Random(3)
    row = [f"{r.randrange(1000):03d}-{r.randrange(100):02d}-{r.randrange(10000):04d}" for _ in range(200)]
    found = pii.find("ssn " + " ".join(row))[1]
    text = "ssn " + " ".join(row)
    assert [text[s:e] for s, e, k in found if k == "ssn"] == row


def test_base_cards_and_phones_equal_the_plain_patterns():
    import re

    r = random.Random(6)
    bits = ["4111 1111 1111 1111", "5500-0000 0000-0004", "+1 (555) 010-9999", "+", "(", ")", "-", ".", " ", "7", "41", "x", "+49 30 1234", "  "]
    for _ in range(800):
        t = "".join(r.choices(bits, k=9))
        got = pii.base_spans(t)
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        cards = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        phones = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
        assert [(s, e) for s, e, k in got if k == "card"] == cards and [(s, e) for s, e, k in got if k == "phone"] == phones


def test_entities_beside_base_spans_in_many_groups_and_in_long_rows():
    kinds = lambda t: [(k, t[s:e]) for s, e, k in pii.find(t)[1]]
    assert kinds("ssn 10.0.0.12 123-45-6789 here") == [("ip", "10.0.0.12"), ("ssn", "123-45-6789")]
    for iban in ("PL61 1090 1014 0000 0712 1981 2874", "FR14 2004 1010 0505 0001 3M02 606"):
        assert kinds(f"iban {iban} ok") == [("iban", iban)], iban
    for lead in range(40, 75):  # wherever an end after 60 letters and digits would have cut
        row = ("12.345/" * 20)[:lead] + " "
        assert ("ssn", "123-45-6789") in kinds(f"ssn {row}123-45-6789"), lead


def test_wav_round_trip_and_resampling():
    data = bytes(range(256)) * 3
    assert audio.read_wav(audio.wav(data)) == (audio.RATE, data)
    x = np.random.default_rng(1).random(300)
    for up, down in ((1, 3), (2, 3), (3, 2)):
        h = audio.low_pass(up, down)
        z = np.zeros(len(x) * up)
        z[::up] = x
        plain = np.convolve(z, h)[len(h) // 2 :][: len(z)][::down]
        y = audio.resample(x, up, down)
        assert np.allclose(y, plain[: len(y)])


def test_hysteresis():
    level = np.array([0, 0, 0, 2, 0.5, 0.5, 0, 0, 0.5, 0.5, 0, 0, 0, 0, 0.0])
    assert audio.segments(level, 1.0, 0.25) == [(3, 6)]


def test_tensors_have_a_fixed_shape():
    found = audio.features(audio.wav(b"ab " * 4000))
    stream = audio.tensors_ipc(found)
    kind = pa.ipc.open_stream(stream).read_all().schema.field("tensor").type
    assert kind.shape == [audio.TILE, audio.MELS] and kind.extension_name == "arrow.fixed_shape_tensor"
    values, spans = audio.read_tensors(stream)
    assert spans == found["spans"] and (values.reshape(len(spans), -1) == found["tensors"]).all() and spans[0][0] == 0
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_log_mel_and_segments_by_the_definition():
    r = np.random.default_rng(8)
    x = np.concatenate((r.normal(0, 0.01, 900), r.normal(0, 0.5, 700), r.normal(0, 0.01, 1500)))
    mel, energy = audio.log_mel(x)
    n = audio.FRAME
    bins, filters = np.arange(n // 2 + 1), audio.mel_filters(audio.RATE * audio.UP // audio.DOWN)
    dft = np.exp(-2j * np.pi * np.outer(np.arange(n), bins) / n)
    frames = 1 + -(-(len(x) - n) // audio.HOP)
    assert len(mel) == len(energy) == frames
    for i in range(frames):
        f = np.zeros(n)
        piece = x[i * audio.HOP : i * audio.HOP + n]
        f[: len(piece)] = piece
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
        power = np.abs((f * window) @ dft) ** 2
        assert np.abs(mel[i] - 1000 * np.log10(power @ filters + 1e-6)).max() <= 1
        assert abs(energy[i] - 10 * np.log10((f**2).mean() + 1e-9)) < 1e-2
    level, on, wanted = energy - np.median(energy), False, []
    for i, v in enumerate([*level, -np.inf]):
        if not on and v >= audio.HIGH:
            on, start = True, i
        elif on and v < audio.LOW:
            on = False
            wanted.append((start, i))
    assert audio.segments(energy) == wanted and len(wanted) >= 1


def test_token_blocks():
    r = np.random.default_rng(3)
    docs = [r.integers(0, top, n).astype(np.uint32) for top, n in ((1, 0), (2, 1), (300, 5000), (50_000, 9000), (2**32 - 1, 300), (1, 4096))]
    keys = [None, None, -5, 7, 7, 1 << 60]
    x = pfor.Shard(pfor.encode_shard(docs, keys, 3, 9))
    back = list(x.documents())
    assert [k for k, _ in back] == keys and all((a == b).all() and len(a) == len(b) for a, (_, b) in zip(docs, back, strict=True)) and (x.part, x.number) == (3, 9)
    flat = np.concatenate(docs)
    for a, b in ((0, 1), (4095, 4097), (100, 14_000), (5, 5), (0, 10**9)):
        assert (x.between(a, b) == flat[a:b]).all()
    few = pfor.Shard(pfor.encode_shard(docs))  # only the blocks asked for are decoded
    few.between(9000, 9001)
    assert few.held[0] == 9000 // pfor.BLOCK and list(pfor.Shard(pfor.encode_shard([])).documents()) == []


def test_bytebpe_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    r = random.Random(4)
    texts = ["".join(r.choices(" \n\t'sdtrevml 12aé!?. -ñ日", k=r.randint(0, 30))) for _ in range(800)] + ["", "  ", "I'm''s x 's <|endoftext|>", "͸ a"]
    texts += [" ".join(r.choices(["'s", "'", "é", "12", "a1", "...", "Ġ", "\u0120x", "\x85", "I'll"], k=300)) for _ in range(20)]
    assert [x.tolist() for x in bytebpe.encode(texts, path)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_n_best_equals_enumeration():
    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(3)
    for _ in range(60):
        t = "".join(r.choices("theanin  ▁é\n☃", k=r.randint(0, 8)))
        norm = pieces.SPACE + t.replace(pieces.SPACE, pieces.LITERAL).replace(" ", pieces.SPACE) if t else ""
        every = [(0, (), 0)]
        done = []
        while every:
            s, ids, at = every.pop()
            if at == len(norm):
                done.append((s, ids))
            every += [(s + x, ids + i, end) for end in range(at + 1, len(norm) + 1) for start, i, x in v.edges(norm, end) if start == at]
        done.sort(key=lambda x: -x[0])
        got = v.encode([t], 5)[0]
        assert [round(x[0] * pieces.SCALE) for x in got] == [x[0] for x in done[:5]]
        assert len({tuple(x.tolist()) for _, x in got}) == len(got) and all(v.decode(x.tolist()) == t for _, x in got)


def test_words_of_any_length(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    v = pieces.vocabulary(path)
    r = random.Random(9)
    words = ["z" * 50_000, "".join(r.choices("abcdefgh", k=30_000)), "☃" * 5000, "ab" * 40, "é▁z" * 70]
    found = [v.encode([w], 4)[0] for w in words]
    for w, x in zip(words, found, strict=True):
        assert all(v.decode(ids) == w for _, ids in x) and [s for s, _ in x] == sorted((s for s, _ in x), reverse=True)
        assert len({ids.tobytes() for _, ids in x}) == len(x) == {"☃": 1, "é": 2}.get(w[0], 4)
        assert round(x[0][0] * pieces.SCALE) == v.forward(pieces.SPACE + w.replace(pieces.SPACE, pieces.LITERAL))[-1]
    every = v.encode(words, 4)
    monkeypatch.setattr(pieces, "FEW", 0)  # words side by side, and kept ones forgotten: the same
    v.kept._clear()
    monkeypatch.setattr(v.kept, "most", 2)
    for again in (every, v.encode(words[2:], 4), v.encode(words[2:], 4)):
        assert all(a[0] == b[0] and (a[1] == b[1]).all() for x, y in zip(again[::-1], found[::-1], strict=False) for a, b in zip(x, y, strict=True))


def test_kept_rows_are_found_after_forgetting():
    kept, r = _chars.Kept(50, 400, 1), np.random.default_rng(2)
    for _ in range(40):
        keys = np.unique(r.integers(0, 200, r.integers(1, 60)).astype(np.uint64))
        v, size = keys.astype(np.int64), keys.astype(np.int64) % 5
        rows = kept.rows(keys, lambda new: (np.repeat(v[new], size[new]), size[new], v[new] * 3))  # noqa: B023
        flat, count = _chars.ragged(kept.ids, kept.offsets, rows)
        assert (count == size).all() and (flat == np.repeat(v, size)).all() and (kept.values[0, rows] == v * 3).all()


def test_word_hashes_of_self_similar_words():
    words = ["a", "b"]
    for _ in range(11):  # Thue-Morse words: polynomials modulo 2**64 can't tell them apart
        words = [words[0] + words[1], words[1] + words[0]]
    c = _chars.Chars([*words, words[0], "ab", "ba"])
    h = _chars.word_hash(c.cp, c.starts[:-1], c.starts[1:])
    assert h[0] == h[2] and len(set(h.tolist())) == 4


def test_chat_escapes_are_reversible():
    r = random.Random(6)
    for _ in range(500):
        t = "".join(r.choices(["<", "|", "\\", "im_end", "|>", "\n", "x"], k=9))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        turns = [("user", t), (f"a%\n{t}", t[::-1]), ("assistant", "")]
        text, mask = chat.format_turns(turns)
        assert chat.read_turns(text) == turns and len(mask) == 1


def test_reply_tree_paths(spark):
    #      1            10 (chain of 9)      null tree: one message
    #    2   3
    #   4
    nodes = [(1, 1, None), (1, 2, 1), (1, 3, 1), (1, 4, 2)] + [(2, k, k - 1 if k > 1 else None) for k in range(1, 10)] + [(None, 1, 99)] + [(3, 1, 2), (3, 2, 1)]
    # leaves under cycles beside rooted ones, a message that is its own parent
    nodes += [(4, 1, 2), (4, 2, 3), (4, 3, 1), (4, 5, 1), (4, 6, 5), (4, 7, 2), (4, 10, None), (4, 11, 10), (5, 1, 1), (5, 2, 1)]
    got = {}
    for r in chat.paths(spark.createDataFrame(nodes, "tree bigint, node bigint, parent bigint")).collect():
        got.setdefault((r.tree, r.leaf), {})[r.distance] = r.node
    assert got == {(1, 3): {0: 3, 1: 1}, (1, 4): {0: 4, 1: 2, 2: 1}, (2, 9): {k: 9 - k for k in range(9)}, (None, 1): {0: 1}, (4, 11): {0: 11, 1: 10}}


def test_branches_equal_a_recursive_query(spark):
    import duckdb

    r = random.Random(11)
    rows = [(t, k, r.randrange(k) if k and r.random() < 0.93 else None, r.choice(["user", "assistant", None]), f"{t}.{k}", r.choice([None, 0.0, 0.25, 0.5, 1.5])) for t in range(40) for k in range(r.randint(1, 60))]
    m = spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, role string, text string, score double")
    got = sorted((x.tree, x["rank"], x.leaf, x.score, [y.text for y in x.turns]) for x in chat.conversations(m, 3).collect())
    c = duckdb.connect()
    c.sql("CREATE TABLE m (tree BIGINT, node BIGINT, parent BIGINT, role VARCHAR, txt VARCHAR, score DOUBLE)")
    c.executemany("INSERT INTO m VALUES (?, ?, ?, ?, ?, ?)", rows)
    wanted = c.sql("""
        WITH RECURSIVE p AS (
          SELECT tree, node AS leaf, node, coalesce(score, 0) AS score, [txt] AS turns FROM m WHERE parent IS NULL
          UNION ALL SELECT m.tree, m.node, m.node, p.score + coalesce(m.score, 0), list_append(p.turns, m.txt) FROM p JOIN m ON m.tree = p.tree AND m.parent = p.node),
        l AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.tree = p.tree AND m.parent = p.node)),
        k AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY score DESC, leaf) AS rank FROM l)
        SELECT tree, rank, leaf, score, turns FROM k WHERE rank <= 3 ORDER BY 1, 2""").fetchall()
    assert got == [tuple(x) for x in wanted]


def test_branches_are_ranked(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", None, 2.0), (1, 4, 1, None, "c", 2.0)]
    m = spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, role string, text string, score double")
    got = sorted((r["rank"], r.leaf, [tuple(t) for t in r.turns]) for r in chat.conversations(m, 2).collect())
    assert got == [(1, 3, [("user", "q"), ("assistant", "")]), (2, 4, [("user", "q"), ("", "c")])]
    assert chat.conversations(m.limit(0)).count() == 0


def test_scans_of_odd_rows(spark, odd):
    s = {(r.doc_id, r.text): r for r in secrets.scan(odd).collect()}
    assert len(s[6, 'token = "0123456789abcdef0123" x@y.org'].spans) == 2 and s[1, None].spans == [] and s[3, LONG].redacted is None
    p = {r.doc_id: [x.kind for x in r.pii] for r in pii.scan(odd).collect()}
    assert p[6] == ["email"] and p[1] == p[2] == p[3] == []
    n = {r.doc_id: r.nbest for r in pieces.encode(odd, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert len(n[1]) == 1 and n[1][0].ids == [] and n[4] == n[5] and len(n[4]) == 4
    for f in (secrets.scan, pii.scan):
        assert f(odd.limit(0)).count() == 0 and f(odd).count() == odd.count()


def test_audio_of_odd_rows(spark, odd):
    clips = audio.to_media(odd)
    f = {(r.doc_id, r.n_bytes): r for r in audio.with_features(clips).collect()}
    assert f[1, 0].n_frames == 1 and f[2, 0].tensors == f[1, 0].tensors and f[4, 4].tensors == f[5, 4].tensors
    media = {r.doc_id: bytes(r.media) for r in clips.collect()}
    assert audio.read_wav(media[3])[1].rstrip() == LONG.rstrip().encode() and len(audio.read_wav(media[2])[1]) == audio.UNIT


def test_token_files_in_order(spark, odd, tmp_path, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for n, shard in enumerate((pfor.SHARD, 3)):
        monkeypatch.setattr(pfor, "SHARD", shard)
        pfor.write(odd, f"{tmp_path}/{n}", path)
        files = [x for x in (tmp_path / str(n)).glob("part-*") if x.stat().st_size]
        assert all(x.read_bytes()[:5] == b"PFOR2" for x in files) and len(files) >= (4 if n else 1)
        rows = sorted(pfor.read_documents(pfor.read(spark, f"{tmp_path}/{n}")).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6] and rows[1].n_tokens == 1
        ids = np.append(bytebpe.encode(["same"], path)[0], np.uint32(pfor.END))
        assert rows[4].ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes()) and [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    pfor.write(odd.limit(0), f"{tmp_path}/none", path)
    assert pfor.read_documents(pfor.read(spark, f"{tmp_path}/none")).count() == 0


def test_digest_of_nothing():
    assert hashlib.sha256(secrets.printed([]).encode()).hexdigest().startswith("e3b0c442")

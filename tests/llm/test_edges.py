"""Nulls, empties, repeats, long texts, empty tables and clashing names for all ten operators and all stages."""

import random
import re
from html.parser import HTMLParser

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kinweave.llm import bpe, chat, decontaminate, html_text, minhash, pii, quality, suffix_dedup, token_counts, url_filter
from kinweave.session import Scratch

DATA = "/root/testdata/sf0.001"
WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LONG = " ".join(f"w{i % 997}" for i in range(40_000))
#: Names that the operators use inside, or give to their results.
NAMES = (
    "id n s1 s2 sig sketch node part tree key a b w border component copies linked c h k lo wanted ranges x own pos len win word offset host strict rate failures failed kept "
    "n_words base_failed contaminated n_hit items item rule verdict pattern path ids decoded n_tokens spans n_spans n_removed n_bytes text_of id_of key_of n_of own_n n_shingles component_id"
).split()


def items(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps"), (2, None), (None, "...")], "item_id long, text string")


OPERATORS = {
    "op1": lambda spark, d: minhash.near_duplicates(d),
    "op2": lambda spark, d: url_filter.filter_urls(d, "text"),
    "op3": lambda spark, d: bpe.digests(d, WORD),
    "op4": lambda spark, d: decontaminate.decontaminate(d, items(spark)),
    "op5": lambda spark, d: pii.detect(d, redacted=True),
    "op6": lambda spark, d: html_text.extract(d, "text"),
    "op7": lambda spark, d: quality.judge(d),
    "op8": lambda spark, d: token_counts.count_tokens(d, BYTE),
    "op9": lambda spark, d: suffix_dedup.remove_repeats(d),
}
ROWS = [(0, None, None), (1, "", "s"), (2, " \n", "s"), (3, "A quick brown fox jumps over", "s"), (3, "A quick brown fox jumps over", "s"), (4, "a QUICK brown fox jumps over", "t"), (5, LONG, "t"), (6, LONG + " x", None), (None, "a b", "s"), (None, None, None)]


def table(spark, rows, kind="long"):
    rows = [(None if i is None else str(i) if kind == "string" else i, *r) for i, *r in rows]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, source string")
    return docs.withColumns({n: F.lit(7) for n in NAMES})


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_rows_pass_one_to_one_beside_any_column(spark, name):
    docs = table(spark, ROWS)
    out = OPERATORS[name](spark, docs)
    assert out.columns[: len(docs.columns)] == docs.columns and len({c.lower() for c in out.columns}) == len(out.columns)
    got = out.collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["text"] or "", r["source"] or "")
    assert sorted(map(key, got), key=str) == sorted(((i is None, i, t or "", s or "") for i, t, s in ROWS), key=str)
    assert all(r[n] == 7 for r in got for n in NAMES)
    # Repeated rows have one result.
    assert len({tuple(r) for r in got if r["doc_id"] == 3}) == 1
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1", "op4", "op9"])
def test_text_ids(spark, name):
    made = [{tuple(map(str, r)) for r in OPERATORS[name](spark, table(spark, ROWS, kind).select("doc_id", "text", "source")).collect()} for kind in ("long", "string")]
    assert made[0] == made[1]


def test_chats_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x" * 200_000), (1, 1, "assistant", None), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    out = chat.digests(chat.format_chats(rows.withColumns({n: F.lit(7) for n in ("formatted", "segments", "valid", "parsed", "turns")})))
    assert {(r.conv_id, r.n_turns, r.loss_chars, r.valid) for r in out.collect()} == {(1, 2, 0, True), (None, 1, 0, False)}
    assert chat.digests(chat.format_chats(rows.limit(0))).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, stage):
    import corpus_pipeline as pipeline

    name, apply = pipeline.STAGES[stage]
    docs = table(spark, ROWS).withColumn("n_chars", F.char_length("text").cast("long"))
    got = Scratch(spark).save(apply(spark, docs, DATA))
    assert apply(spark, docs.limit(0), DATA).count() == 0
    if name != "bpe":
        assert got.columns == docs.columns
    # What each stage keeps: all rows with 50 words or more that don't repeat themselves; the first of each group.
    kept = {"quality_rules": {5, 6}, "near_dedup": {0, 1, 2, 3, 5, None}}.get(name, {i for i, *_ in ROWS})
    assert {r.doc_id for r in got.select("doc_id").collect()} <= kept if name == "quality_rules" else {r.doc_id for r in got.select("doc_id").collect()} == kept


def test_many_rules_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeABC12") for _ in range(rng.randint(1, 3)))
    patterns = tuple({rng.choice(["", "^", "|", "*"]) + word() + rng.choice(["", "^", "*", "/", "."]) + word() + rng.choice(["", "^", "|"]) for _ in range(10_000)})
    hosts = tuple({url_filter.HostRule(rng.choice(["allow", "block"]), f"{word()}.{word()}", rng.choice(["", "/", f"/{word()}", f"/{word()}/"])) for _ in range(500)})
    hosts = tuple({h.name: h for h in hosts}.values())
    urls = [f"http://{word()}.{word()}.{word()}/{word()}/{word()}?{word()}" for _ in range(150)]
    compiled = [(p, re.compile(url_filter.to_regex(p))) for p in sorted(patterns)]
    low = lambda s: s.translate(url_filter._LOWER)

    def brute(url):
        host, slash, path = url[7:].partition("/")
        host, path = low(host), (slash + path).partition("?")[0]
        fits = [h for h in hosts if (host == low(h.host) or host.endswith("." + low(h.host))) and path.startswith(h.path)]
        best = max(fits, key=lambda h: (len(h.name), h.name), default=None)
        return best.name if best else None, next((p for p, r in compiled if r.search(low(url))), None)

    out = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), hosts=hosts, patterns=patterns)
    assert {r.page_id: (r.rule, r.pattern) for r in out.collect()} == dict(enumerate(map(brute, urls)))
    (tmp_path / "rules.txt").write_text("# rules\nallow org/\nblock Example.com/De\n\n^Casino^\n")
    assert url_filter.read_rules(spark, str(tmp_path / "rules.txt")) == ((url_filter.HostRule("allow", "org", "/"), url_filter.HostRule("block", "Example.com", "/De")), ("^Casino^",))
    index = url_filter.RuleIndex((url_filter.HostRule("block", "com", "/Fr/"),), ("^Casino^", "/Ads/"), {})
    assert index.judge("http://a.COM/Fr/x")[2:4] == ("com/Fr/", "block") and index.judge("http://x.net/casino")[4] == "^Casino^" and index.judge("http://x.net/ads/")[4] == "/Ads/"


class Blocks(HTMLParser):
    """The texts between block tags, by the standard library's parser."""

    def __init__(self, source):
        super().__init__()
        self.found, self.held, self.raw = [], [], None
        self.feed(source)
        self.close()
        self.cut()

    def cut(self):
        text = " ".join("".join(self.held).split())
        self.found += [text] if text else []
        self.held = []

    def handle_starttag(self, tag, attrs):
        if not self.raw and (tag in html_text.BLOCK or tag == "br"):
            self.cut()
        self.raw = self.raw or (tag if tag in html_text.RAW else None)

    def handle_endtag(self, tag):
        if tag == self.raw:
            self.raw = None
        elif not self.raw and tag in html_text.BLOCK:
            self.cut()

    def handle_data(self, data):
        if not self.raw:
            self.held.append(data)


def test_html_blocks_against_another_parser(spark):
    rng = random.Random(17)
    pages = [html_text.generate(rng)[0] for _ in range(100)] + [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect() if r.html]
    for source in pages:
        assert [t for _, t in html_text.Page(source).blocks] == Blocks(source).found


@pytest.mark.parametrize("source", ["<a " * 100_000, '<a x="' * 50_000, "<div>" * 20_000 + "</p>" * 20_000, "<p title='" * 30_000 + ">x", "<script>" * 30_000, "<body>" * 20_000, "<" * 100_000])
def test_hostile_pages_end(source):
    assert isinstance(html_text.extract_all([source, None], html_text.model())[0], str)


def test_long_words_against_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(9)
    words = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in (("abcdefghijklmnopqrstuvwxyz", 300_000), ("a", 50_000), ("aab", 20_000), ("語é", 9_000), ("etaoin", 1_100))]
    for path in (WORD, BYTE):
        library, codec = Tokenizer.from_file(path), bpe.Codec(path)
        for w in words:
            assert codec.encode([w])[0][0] == " ".join(map(str, library.encode(w, add_special_tokens=False).ids))


def test_contamination_with_a_prefix_table_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 900)
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {tuple(r) for r in decontaminate.decontaminate(docs, bench, keep=["doc_id"]).collect()}
    monkeypatch.undo()
    assert got == {tuple(r) for r in decontaminate.decontaminate(docs, bench, keep=["doc_id"]).collect()}

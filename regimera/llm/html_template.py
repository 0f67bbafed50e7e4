"""Main-text extraction by equivalence-class template deduction.

Pages of a host are made from templates. Tokens are block tags, told apart by the path of elements above them and by class
(div, section and td without one by their place), and words, told apart by path and by the words before them in their block. A token's occurrence vector holds its count on each
page of the host; tokens with equal vectors form an equivalence class. A class is valid if a tag anchors it, at least
SUPPORT pages hold it, and it nests: it lies below one token of its parent class, and where it repeats on a page all its
tokens leave it into the same class. The valid classes, nested, are the host's templates: classes with one occurrence
a page are the fixed frame of those pages that hold them (several templates on a host give several frames), others are
repeated records such as list items and paragraphs. As a word's role holds all words before it, a block is fixed text if its
last word is in a class; so only last words are carried.

Between template tokens lie the slots. The article is, on each page, the element of a frame whose slot holds most of the
running text over all pages with that frame. From that slot go: elements that HTML itself names as menu, footer, form,
aside and the like; blocks of fixed text (notices, bylines, labels that every page of the template repeats); and template
containers that are mostly links over all pages or whose every class name says menu, notice, advert, comments and so on. All
other blocks stay. If fixed text would be most of an article, as where all pages of a small host are copies, it is taken
for content. Class names otherwise only help to choose among slots. Pages whose host has no template with SUPPORT
pages are scored alone in the same way, without fixed text. Templates with the same tags are one: a line that only part of its
pages repeat has no anchor and stays, as a passage that many articles share does.

Scale: a task counts the tokens of its pages by host and sends a row for each token and host: tags of the template and one
word a block, some tens of bytes each. Vectors are carried as sums over pages: support, occurrences, and two 64-bit
signatures of (page, count), which are equal for equal vectors and merge by addition, so a host with a third of all
pages is merged by token all over the cluster and no page is shuffled for its template. What meets in one task for
a host are its tags with SUPPORT pages and the words that share a tag's vector: its template. Templates (a row for each
host) are joined to the pages by host; the engine broadcasts them only below its size threshold and otherwise splits
skewed hosts.

Cases: a null or empty html gives an empty text; markup that is cut off, not nested or nested very deep is read as far
as it goes, in time linear in the page; a null url is a host of its own; repeated pages are extracted each and count each;
ties between slots go to the lower token; an empty table gives an empty result; extra columns are ignored; character references
are decoded, an unfinished one stays as it is. Tokens are told apart by 63-bit hashes.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship
from .textkernel import lean, mix64

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CHROME_TAGS = frozenset("nav footer aside form head menu dialog button select search fieldset".split()) | RAW
CHROME_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|side-?bar\w*|foot\w*|header|masthead|cookie\w*|consent|notice|"
    r"alert|pop-?up|modal|comments?|respond|reply|replies|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|"
    r"breadcrumbs?|pagination|pager|widget|skip|copyright|legal|tags?|toolbar|hidden)(?:$|[\s_-])",
    re.I,
)
CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|main|story|body|text)(?:$|[\s_-])", re.I)
CLOSES_P = BLOCK - {"html", "body", "head"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:/?>|\Z|(?=<))", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
#: Elements that a class name can mark as no content.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section ul ol dl table details figure center li header".split())
#: Least pages of a class.
SUPPORT = 3
#: Without a class these are told apart by their place among each other.
PLACED = frozenset("div section td".split())
#: A template element with this share of link text is a menu.
LINK_SHARE = 0.6
#: Rows of counts that a task holds before it merges and, if still more, sends them.
HELD = 1 << 20
_MASK = (1 << 63) - 1


class Node:
    """A block element of a page. key: hash of its path; text, link: characters directly inside, then of all below it.

    away: HTML names it as no content. soft: some name of its class does. side: all names of a container's class do.
    """

    __slots__ = ("away", "deep", "inside", "key", "kids", "label", "link", "named", "parent", "running", "side", "soft", "tag", "text")

    def __init__(self, tag: str, label: str, key: int, parent: Node | None):
        self.tag, self.label, self.key, self.parent = tag, label, key, parent
        self.text = self.link = self.running = 0
        self.kids = 0  # classless containers directly inside so far
        self.away = self.soft = self.side = self.named = self.inside = False
        self.deep = parent.deep + 1 if parent is not None else 0


def path_key(above: int, label: str) -> int:
    """Token of an element: the hash of its label and of the token above."""
    return xxhash.xxh3_64_intdigest(above.to_bytes(8, "little") + label.encode("utf-8", "surrogatepass")) & _MASK


def _names(attributes: str) -> str:
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    return " ".join(x for x in (found.get("class"), found.get("id"), found.get("role")) if x)


def _element(tag: str, attributes: str, above: Node, keys: dict) -> Node:
    names = _names(attributes)
    label = tag + "".join("." + x for x in sorted(set(names.split())) if not any(c.isdigit() for c in x))
    if label in PLACED:
        above.kids += 1
        label += f"~{above.kids}"
    known = keys.get((above.key, label))
    if known is None:
        known = keys[above.key, label] = path_key(above.key, label)
    node = Node(tag, label, known, above)
    node.inside = above.inside or tag in ("article", "main")
    node.away = above.away or tag in CHROME_TAGS or tag == "header" and not above.inside
    content = bool(names and CONTENT_NAMES.search(names))
    node.named = tag in ("article", "main") or content
    plain = not names or tag in ("html", "body", "article", "main") or content
    node.soft = above.soft or node.away or not plain and bool(CHROME_NAMES.search(names))
    node.side = not plain and tag in CONTAINERS and all(map(CHROME_NAMES.search, names.split()))
    return node


def read(page: str | None, keys: dict | None = None) -> tuple[list[Node], list[tuple[Node, str]]]:
    """(block elements in page order, blocks of text with the element each lies in). keys: a memo of path_key."""
    page, keys = page or "", {} if keys is None else keys
    root = Node("", "", 0, None)
    nodes, blocks = [root], []
    stack, parts, opened, endless = [root], [], Counter(), set()
    links, at, n = 0, 0, len(page)

    def text(raw: str) -> None:
        if raw:
            parts.append(raw)
            if links:
                stack[-1].link += len(raw)

    def flush() -> None:
        if parts:
            line = " ".join(html_lib.unescape("".join(parts)).split())
            parts.clear()
            if line:
                blocks.append((stack[-1], line))
                stack[-1].text += len(line)
                stack[-1].running += weight(len(line), stack[-1].tag)

    def close() -> None:
        opened[stack.pop().tag] -= 1

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                flush()
                if opened[tag]:
                    while stack[-1].tag != tag:
                        close()
                    close()
            elif tag == "a" and links:
                links -= 1
            continue
        if tag in RAW:
            end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if end is None:
                endless.add(tag)
            if end is not None or tag not in ("svg", "math", "object", "video", "audio", "canvas", "noscript", "template", "select"):
                at = end.end() if end else n
            continue
        if tag in ("br", "wbr"):
            parts.append(" " if tag == "br" else "")
            continue
        if tag == "a":
            links += 1
        if tag not in BLOCK:
            continue
        flush()
        links = 0
        if tag in VOID:
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            close()
        same = SAME_LEVEL.get(tag)
        if same and stack[-1].tag in same:
            close()
            if tag == "tr" and stack[-1].tag == "tr":
                close()
        node = _element(tag, m[3], stack[-1], keys)
        nodes.append(node)
        stack.append(node)
        opened[tag] += 1
    flush()
    for x in nodes:
        x.running = 0 if x.soft else max(0, int(x.running) - 2 * x.link)
    for x in reversed(nodes):  # elements stand before what is inside them
        if x.parent is not None:
            x.parent.running += x.running
            x.parent.text += x.text
            x.parent.link += x.link
    return nodes, blocks


def weight(n: int, tag: str) -> float:
    """Characters of running text that a block of n counts for: short loose lines little, headings double."""
    return 2 * n if tag in HEADINGS else n * min(1.0, n / 80) ** 2


def slot_score(share: float, named: float, depth: int) -> float:
    """Prefers the innermost element that holds nearly all running text; content elements count as holding more."""
    return share * (1 + 0.6 * named) + 0.005 * min(depth, 100)


def last_words(blocks: list[tuple[Node, str]]) -> list[int]:
    """The token of each block's last word: the path of its element and all words of the block."""
    return [xxhash.xxh3_64_intdigest(x.key.to_bytes(8, "big") + line.encode("utf-8", "surrogatepass")) & _MASK for x, line in blocks]


def signature(mark: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of (page, count): one to add by exclusive or, one of 31 bits to add up."""
    h = mix64(mark + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h.view(np.int64), (h >> np.uint64(33)).astype(np.int64)


#: What is summed for a tag besides its vector: running text below it and on its pages, link and all text below it, marks.
TAG_SUMS = ("below", "whole", "link", "total", "named", "side")
VECTOR = ("pages", "occurrences", "xor", "sum")
STATS = "host string, kind int, token bigint, parent bigint, label string, depth int, pages bigint, occurrences bigint, xor bigint, sum bigint, " + ", ".join(f"{c} bigint" for c in TAG_SUMS)


class _Counts:
    """Sums by (host, token) of rows (pages, occurrences, xor, sum, more...)."""

    def __init__(self, more: int = 0):
        self.more, self.parts, self.size = more, [], 0

    def add(self, host: np.ndarray, token: np.ndarray, *columns: np.ndarray) -> None:
        self.parts.append((host, token, *columns))
        self.size += len(host)

    def merged(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            empty = np.zeros(0, np.int64)
            return (empty,) * (6 + self.more)
        host, token, *columns = (np.concatenate([p[i] for p in self.parts]) for i in range(6 + self.more))
        order = np.lexsort((token, host))
        host, token = host[order], token[order]
        first = np.flatnonzero(np.concatenate([[True], (host[1:] != host[:-1]) | (token[1:] != token[:-1])])) if len(host) else np.zeros(0, np.int64)
        out = [(np.bitwise_xor if i == 2 else np.add).reduceat(c[order], first) if len(first) else c for i, c in enumerate(columns)]
        self.parts = [(host[first], token[first], *out)]
        self.size = len(first)
        return self.parts[0]


def token_stats(pages: DataFrame) -> DataFrame:
    """pages: (host, html). Rows by STATS for each host and token: tags (kind 0) and last words outside of what HTML names as no content (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags, words, facts, keys = _Counts(len(TAG_SUMS)), _Counts(), {}, {}
        hosts: dict[str, int] = {}

        def send() -> pa.RecordBatch:
            names = list(hosts)
            t, w = tags.merged(), words.merged()
            about = [facts[x] for x in t[1].tolist()]
            columns = [[names[i] for i in np.concatenate([t[0], w[0]]).tolist()], np.repeat([0, 1], [len(t[0]), len(w[0])]), np.concatenate([t[1], w[1]])]
            columns += [[x[i] for x in about] + [None] * len(w[0]) for i in range(3)]
            columns += [np.concatenate([t[i], w[i]]) for i in range(2, 6)] + [np.concatenate([c, np.zeros(len(w[0]), np.int64)]) for c in t[6:]]
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * (4 + len(TAG_SUMS))]
            tags.parts, words.parts, tags.size, words.size = [], [], 0, 0
            facts.clear(), hosts.clear(), keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], [x.split()[0] for x in STATS.split(", ")])

        for batch in batches:
            for host, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = cell.as_py() or ""
                nodes, blocks = read(page, keys)
                mark = xxhash.xxh3_64_intdigest(page.encode("utf-8", "surrogatepass"))
                at, whole, sums = hosts.setdefault(host, len(hosts)), nodes[0].running, {}
                for x in nodes:
                    row = sums.setdefault(x.key, [0, 0, 0, 0, 0, 0, 0])
                    row[0] += x.running
                    row[2] += x.link
                    row[3] += x.text
                    row[4], row[5] = row[4] or x.named, row[5] or x.side
                    row[6] += 1
                    if x.key not in facts:
                        facts[x.key] = (x.parent.key if x.parent is not None else -1, x.label, x.deep)
                each = np.array(list(sums.values()), np.int64)
                each[:, 1] = whole
                fixed = Counter(last_words([b for b in blocks if not b[0].away]))
                for to, token, n, more in ((tags, sums, each[:, 6], each[:, :6].T), (words, fixed, np.array(list(fixed.values()), np.int64), ())):
                    many = len(token)
                    to.add(np.full(many, at, np.int64), np.array(list(token), np.int64), np.ones(many, np.int64), n, *signature(np.uint64(mark), n), *more)
                if tags.size + words.size > HELD or len(tags.parts) > 4096:
                    tags.merged(), words.merged()
                    if tags.size + words.size > HELD // 2:
                        yield send()
        if hosts:
            yield send()

    rows = pages.select("host", "html").mapInArrow(lean(run), STATS)
    sums = [F.sum(c).alias(c) for c in ("pages", "occurrences")] + [F.bit_xor("xor").alias("xor"), F.sum("sum").alias("sum")] + [F.sum(c).alias(c) for c in TAG_SUMS]
    return rows.groupBy("host", "kind", "token").agg(F.min("parent").alias("parent"), F.min("label").alias("label"), F.min("depth").alias("depth"), *sums)


def equivalence_classes(rows: list[tuple], support: int = SUPPORT) -> list[dict]:
    """rows: (kind, token, parent, depth, vector). Classes of tokens with one vector (its first two entries: pages, occurrences), outermost first.

    Each has its tags and words, the class it nests in, and whether it is valid. Parents of tags must be among the rows.
    """
    groups: dict[tuple, tuple[list, list]] = defaultdict(lambda: ([], []))
    above, deep = {}, {}
    for kind, token, parent, depth, vector in rows:
        groups[vector][kind].append(token)
        if kind == 0:
            above[token], deep[token] = parent, depth
    classes = [
        {"tags": sorted(t, key=lambda x: (deep[x], x)), "words": sorted(w), "pages": v[0], "occurrences": v[1], "parent": None, "valid": False}
        for v, (t, w) in groups.items() if t
    ]
    classes.sort(key=lambda c: (deep[c["tags"][0]], c["tags"][0]))
    owner = {t: i for i, c in enumerate(classes) for t in c["tags"]}
    for i, c in enumerate(classes):
        exits, common = set(), None
        for t in c["tags"]:
            up = above.get(t, -1)
            while up in owner and owner[up] == i:
                up = above[up]
            if up not in owner:
                continue  # the outermost token
            exits.add(owner[up])
            chain = []
            while up in owner:
                chain.append(up)
                up = above[up]
            common = chain if common is None else [x for x in common if x in set(chain)]
        if common:
            c["parent"] = owner[common[0]]
        nested = len(exits) <= 1 or c["occurrences"] == c["pages"]
        c["valid"] = c["pages"] >= support and nested and (c["parent"] is None or classes[c["parent"]]["pages"] >= c["pages"])
    return classes


def template(rows: pd.DataFrame, support: int = SUPPORT) -> dict:
    """The template of one host from its token rows: slots with scores, elements to leave out, template words."""
    vectors = list(rows[list(VECTOR)].itertuples(index=False, name=None))
    classes = equivalence_classes([(int(k), int(t), int(p) if p == p else -1, int(d) if d == d else 0, v) for k, t, p, d, v in zip(rows["kind"], rows["token"], rows["parent"], rows["depth"], vectors)], support)
    valid = [c for c in classes if c["valid"]]
    fact = {int(r.token): r for r in rows[rows["kind"] == 0].itertuples()}
    slots, away = {}, []
    for c in valid:
        for t in c["tags"]:
            r = fact[t]
            if c["occurrences"] == c["pages"] and r.below > 0:
                slots[t] = slot_score(r.below / max(1, r.whole), r.named / r.pages, int(r.depth))
            tag = re.split("[.~]", r.label or "")[0]
            if tag in CONTAINERS and (r.side > 0 or r.total > 0 and r.link >= LINK_SHARE * r.total):
                away.append(t)
    return {"slots": sorted(slots), "scores": [slots[t] for t in sorted(slots)], "away": sorted(away), "words": sorted(w for c in valid for w in c["words"])}


def templates(pages: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(host, slots, scores, away, words) for each host with a token on `support` pages."""
    stats = materialise(token_stats(pages).where(F.col("pages") >= support), "html-tokens")
    tags = stats.where("kind = 0")
    anchored = stats.where("kind = 1").join(tags.select("host", *VECTOR).distinct(), ["host", *VECTOR], "left_semi").select(tags.columns)

    def deduce(rows: pd.DataFrame) -> pd.DataFrame:
        made = template(rows, support)
        return pd.DataFrame({"host": [rows["host"].iloc[0]]} | {k: [v] for k, v in made.items()})

    return tags.unionByName(anchored).groupBy("host").applyInPandas(deduce, "host string, slots array<bigint>, scores array<double>, away array<bigint>, words array<bigint>")


def article(page: str | None, made: dict | None = None, keys: dict | None = None) -> str:
    """The article's blocks joined by blank lines; made is the template of the host, if it has one."""
    nodes, blocks = read(page, keys)
    if not blocks:
        return ""
    here = [x for x in nodes if not x.away]
    scores = made["scores"] if made else {}
    place = max((x for x in here if x.key in scores), key=lambda x: (scores[x.key], -x.key), default=None)
    away = made["away"] if made else frozenset()
    if place is None:
        count, whole = Counter(x.key for x in nodes), max(1, nodes[0].running)
        place = max((x for x in here if count[x.key] == 1 and x.running > 0 and x.parent is not None), key=lambda x: (slot_score(x.running / whole, x.named, x.deep), -x.key), default=nodes[0])
    slot, kept, gone = place.key, set(), set()
    for x in nodes:
        up = x.parent
        if up in gone or x.away or x is not place and x.key != slot and (x.key in away or not made and x.side):
            gone.add(x)
        elif x.key == slot or up in kept:
            kept.add(x)
    lines = [b for b in blocks if b[0] in kept]
    if made and made["words"]:
        rest = [line for (_, line), token in zip(lines, last_words(lines)) if token not in made["words"]]
        if 2 * sum(map(len, rest)) >= sum(len(line) for _, line in lines):
            return "\n\n".join(rest)
    return "\n\n".join(line for _, line in lines)


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def extract(pages: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html)."""
    ship(pages.sparkSession)
    rows = pages.select("page_id", "url", "html", host_of().alias("host"))
    found = materialise(templates(rows.select("host", "html"), support), "html-templates")
    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "host", "slots", "scores", "away", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict = {}
        for batch in batches:
            made: dict[str, dict | None] = {}
            texts = []
            for i, host in enumerate(batch.column(3).to_pylist()):
                if host not in made:
                    slots, scores, away, words = (batch.column(k)[i] for k in range(4, 8))
                    made[host] = {"scores": dict(zip(slots.as_py(), scores.as_py())), "away": frozenset(away.as_py()), "words": frozenset(words.as_py())} if slots.is_valid else None
                texts.append(article(batch.column(2)[i].as_py(), made[host], keys))
            if len(keys) > 1 << 20:
                keys.clear()
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return joined.mapInArrow(lean(run), f"page_id {kind}, url string, text string, n_chars bigint")

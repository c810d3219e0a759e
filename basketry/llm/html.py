"""Main text of web pages by wrappers inferred per host.

Pages of a host mostly come from one template. Each page is read into a stream of block tokens and text
slots. The streams of a host are aligned one after the other: at every level the k-th element of a label meets the
k-th of the other page, an element that one page lacks becomes optional, and elements that stand there a
different number of times become a repeated group. The result is a regular expression without unions, the wrapper.

Every page is then matched against the wrapper of its host, which gives each text block the number of its slot. What
a slot holds on all pages decides: one text on different pages is the template's, texts that differ are the
page's, and where no page names its article the deepest element that holds all differing text is it. Article and main
elements and class words are hints for single blocks.

A host may hold most pages. Nothing gathers its pages: every batch of a task aligns its own pages, the wrappers of the
batches are merged under salts and then once more, and slot sums are ordinary aggregates.
"""

from __future__ import annotations

import html as references
import re
import sys
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from basketry.llm.common import arrow_pass, settled
from basketry.operators.sizing import small_side

# Fixed values of the HTML standard: elements by the way they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul svg select button".split()
)
# What a start tag closes if it is open, and what it does not look beyond.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}

# Elements and words in class, id or role that mark what is not the article.
OUTSIDE = frozenset("nav aside footer form head dialog menu select button svg script style".split())
NOT_ARTICLE = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus dialog discussion footer form gdpr login menu menubar modal nav navbar navigation newsletter notice "
    "notices notification overlay pager pagination popup promo promoted promotion related reply replies respond search "
    "share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe subscription toolbar topbar "
    "complementary contentinfo alert".split()
)
# What may stand beside them in the name of a widget; inside an article only whole names count ("ad-box", not "tag-search").
PARTS = frozenset(
    "area bar block box button buttons container content form icons inner item items label layer left link links list "
    "module outer panel post posts right section slot top bottom thread unit widget widgets wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Ids that mark a section of an article; others are the slugs of its title ("discussion", "related-work").
SECTION_IDS = frozenset("comments respond replies disqus".split())
# Text from which a form that holds most of a page is the page, whatever fields it has.
FORM_CHARS = 200
HEADERS = frozenset("header masthead".split())
MAIN = frozenset("article main".split())
# Elements that hold one piece of an article, never all of it.
TEXT_ELEMENTS = frozenset("p li h1 h2 h3 h4 h5 h6 td blockquote pre".split())
# "has-sidebar" says something about the page, not about the element.
ABOUT = frozenset("no not has with without is".split())
SALTS = 32
# Different pages with one text in a slot that make it the template's.
CONSTANT_PAGES = 3
# Elements whose class words describe the page, and elements whose id is a slug of their text: such words are no label.
PAGE_CLASSES = frozenset("html body article main".split())
SLUGS = frozenset("h1 h2 h3 h4 h5 h6 section article main body html p li".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HOST = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty for null and for what is no URL."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


class Block:
    """Text between two block tags: the labels it stands in, whether a marked element holds it, its text and link text."""

    __slots__ = ("path", "outside", "main", "pieces", "links")

    def __init__(self, path: tuple[str, ...], outside: bool, main: bool):
        self.path, self.outside, self.main, self.pieces, self.links = path, outside, main, [], 0

    def text(self) -> str:
        return " ".join(references.unescape("".join(self.pieces)).split())


def _label(tag: str, attributes: str) -> tuple[str, set[str]]:
    """(tag with the words of its class and id that name its place, all words of class, id and role)."""
    words: set[str] = set()
    classes: list[str] = []
    if attributes and ("=" in attributes):
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            found = [w.lower() for w in _WORDS.findall(a or b or c)]
            if not ABOUT & set(found):
                words.update(found)
            if key.lower() == "class" and tag not in PAGE_CLASSES or key.lower() == "id" and tag not in SLUGS:
                classes += found
    return ".".join([tag, *sorted(set(classes))]), words


def _widget(tag: str, attributes: str) -> bool:
    """True if an element inside an article, or an article itself, has the whole name of what is not the article."""
    if tag in HEADINGS:
        return False
    found = [(key.lower(), (a or b or c).split()) for key, a, b, c in _ATTRIBUTE.findall(attributes or "")]
    section = tag == "section" or any("section" in names for key, names in found if key == "class")
    for key, names in found:
        for name in names:
            words = {w.lower() for w in _WORDS.findall(name)}
            if key == "id" and tag in MAIN or key == "id" and section and not words <= SECTION_IDS:
                continue
            if words & NOT_ARTICLE and words <= NOT_ARTICLE | PARTS:
                return True
    return False


def blocks(page: str) -> tuple[list[Block], list[str]]:
    """The blocks of a page in order and its stream of block tokens, ``<label``, ``>`` and ``#`` for text."""
    found: list[Block] = []
    stream: list[str] = []
    # tag, label, outside, main, number of the form
    stack: list[tuple[str, str, bool, bool, int]] = []
    # per form: has fields, holds an article
    forms: list[list[bool]] = []
    form_of: list[int] = []
    block: Block | None = None
    link = False

    def close(depth: int) -> None:
        while len(stack) > depth:
            stack.pop()
            stream.append(">")

    def leave_head() -> None:
        """Text and block elements end a head that was left open."""
        if stack and stack[-1][0] == "head":
            close(len(stack) - 1)

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        token = m.group()
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            if token[0] == "<" and len(token) > 1:  # comment, doctype, instruction
                continue
            if block is None:
                if not token.strip():
                    continue
                leave_head()
                above = stack[-1] if stack else ("", "", False, False, -1)
                block = Block(tuple(s[1] for s in stack), above[2], above[3])
                found.append(block)
                form_of.append(above[4])
                stream.append("#")
            block.pieces.append(token)
            if link:
                block.links += len(token)
            continue
        tag = tag.lower()
        if tag in ("input", "textarea", "select") and stack and stack[-1][4] >= 0 and "hidden" not in token.lower():
            forms[stack[-1][4]][0] = True
        end = bool(m.group(1) or m.group(4))
        if not end and tag in RAW:
            over = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = size if over is None else (page.find(">", over.start()) + 1 or size)
            continue
        if tag == "a":
            link = not end
            continue
        if tag == "br":
            if block is not None:
                block.pieces.append(" ")
            continue
        if tag not in BLOCK:
            continue
        block, link = None, False
        if end:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            continue
        leave_head()
        if stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in CLOSES:
            shut, stop = CLOSES[tag]
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in stop:
                    break
                if stack[depth][0] in shut:
                    close(depth)
                    break
        if tag in VOID:
            continue
        label, words = _label(tag, m.group(3) or m.group(6) or "")
        above = stack[-1] if stack else ("", "", False, False, -1)
        form = above[4]
        if tag == "form" and form < 0:
            form = len(forms)
            forms.append([False, False])
        named = _widget(tag, m.group(3) or m.group(6)) if above[3] or tag in MAIN else bool(words & NOT_ARTICLE)
        marked = tag not in ("html", "body", "form") and (tag in OUTSIDE or named)
        if tag == "form" and words & NOT_ARTICLE:
            marked = True
        if not above[3] and tag not in MAIN and (tag == "header" or words & HEADERS) and tag not in ("html", "body"):
            marked = True
        outside = above[2] or marked
        main = not outside and (above[3] or tag in MAIN or "main" in words and tag != "body" or "articlebody" in words)
        if main and not above[3] and form >= 0:
            forms[form][1] = True
        stack.append((tag, label, outside, main, form))
        stream.append("<" + label)
    close(0)
    if forms:
        sizes = [0 if b.outside else len(b.text()) for b in found]
        for number, (fields, article) in enumerate(forms):
            held = sum(n for n, f in zip(sizes, form_of) if f == number)
            if article or 2 * held >= sum(sizes) and (held >= FORM_CHARS or not fields):
                continue  # the form is around the page
            for block, f in zip(found, form_of):
                block.outside = block.outside or f == number
    return found, stream


# Pages may be nested as deep as they are long; calls between Python functions take no room on the machine's stack.
DEEPEST = 1_000_000


def _go_deep() -> None:
    sys.setrecursionlimit(max(DEEPEST, sys.getrecursionlimit()))


# A wrapper is a list of items; an item is [label, flags, children], "#" being a text slot without children.
# Flags: 1 optional, 2 repeated; of a text slot also 4 and 8, see ``decided``. A label that is not repeated may
# stand several times in a level: its k-th item is the k-th element of that label on every page that has it.
Wrapper = list[list]
OPTIONAL, REPEATED, ARTICLE, PLACE = 1, 2, 4, 8


def wrapper_of(stream: list[str]) -> Wrapper:
    """The stream of one page as nested items."""
    root: Wrapper = []
    levels = [root]
    for token in stream:
        if token == ">":
            levels.pop()
        elif token == "#":
            levels[-1].append(["#", 0, []])
        else:
            item = [token[1:], 0, []]
            levels[-1].append(item)
            levels.append(item[2])
    return root


def _with_runs_merged(items: Wrapper, counts: Counter) -> Wrapper:
    """Items that stand side by side, and nowhere else, merged into one that is repeated."""
    out: Wrapper = []
    at = 0
    while at < len(items):
        item, size = items[at], counts[items[at][0]]
        if size > 1 and at + size <= len(items) and all(i[0] == item[0] for i in items[at : at + size]):
            inner, flags = item[2], item[1]
            for other in items[at + 1 : at + size]:
                inner, flags = aligned(inner, other[2]), flags | other[1]
            item, at = [item[0], flags | 2, inner], at + size
        else:
            at += 1
        out.append(item)
    return out


def folded(items: Wrapper) -> Wrapper:
    """Items in which no label stands twice: what lies between two occurrences is one turn of a repeated group, and
    items missing from a turn are optional."""
    while True:
        counts = Counter(i[0] for i in items)
        if len(counts) == len(items):
            return items
        merged = _with_runs_merged(items, counts)
        if len(merged) < len(items):
            items = merged
            continue
        repeated = next(i[0] for i in items if counts[i[0]] > 1)
        starts = [i for i, item in enumerate(items) if item[0] == repeated]
        turns = [items[a:b] for a, b in zip(starts, starts[1:])]
        # the last turn goes as far as it resembles the others
        known = {i[0] for t in turns for i in t}
        end = starts[-1]
        while end < len(items) and (items[end][0] in known or end == starts[-1]):
            end += 1
        turns.append(items[starts[-1] : end])
        group = folded(turns[0])
        for turn in turns[1:]:
            group = aligned(group, folded(turn))
        for item in group:
            item[1] |= 2
        items = items[: starts[0]] + group + items[end:]


def _common(a: Wrapper, b: Wrapper) -> list[tuple[int, int]]:
    """Places of a longest common sequence of first entries. None stands twice in a list, so it is a longest rising
    sequence of places."""
    where = {item[0]: j for j, item in enumerate(b)}
    pairs = [(i, where[item[0]]) for i, item in enumerate(a) if item[0] in where]
    ends: list[int] = []  # least last place of a rising sequence of each length
    last: list[int] = []  # the pair it ends with
    before = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        before.append(last[at - 1] if at else -1)
        ends[at : at + 1] = [j]
        last[at : at + 1] = [k]
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def _counted(items: Wrapper) -> dict[str, int]:
    """How often each label stands in a level, 0 if it is repeated."""
    counts: dict[str, int] = {}
    for label, flags, _ in items:
        counts[label] = 0 if flags & REPEATED else counts.get(label, 0) + 1
    return counts


def _gathered(items: Wrapper, labels: set[str]) -> Wrapper:
    """Items of each of these labels as one repeated item where the first stood; halves are aligned first."""
    if not labels:
        return items
    groups: dict[str, list] = defaultdict(list)
    for item in items:
        if item[0] in labels:
            groups[item[0]].append(item)
    out = []
    for item in items:
        if item[0] not in labels:
            out.append(item)
        elif item is groups[item[0]][0]:
            group, flags = [i[2] for i in groups[item[0]]], REPEATED
            for other in groups[item[0]]:
                flags |= other[1]
            while len(group) > 1:
                pairs = [aligned(x, y) for x, y in zip(group[::2], group[1::2])]
                group = pairs + group[len(group) - len(group) % 2 :]
            out.append([item[0], flags, group[0]])
    return out


def _numbered(items: Wrapper) -> list[list]:
    """The keys of a level: label and number among the items of that label."""
    counts: dict[str, int] = {}
    keys = []
    for label, *_ in items:
        counts[label] = counts.get(label, 0) + 1
        keys.append([(label, counts[label])])
    return keys


def aligned(a: Wrapper, b: Wrapper) -> Wrapper:
    """One level that matches what either matches.

    Labels that stand a different number of times become repeated items, items that one side lacks or has
    in another order optional ones. Which items are repeated does not depend on the order in which pages are aligned.
    """
    of_a, of_b = _counted(a), _counted(b)
    varying = {label for label, n in of_a.items() if label in of_b and (n == 0 or n != of_b[label])}
    a, b = _gathered(a, varying), _gathered(b, varying)
    keys_a, keys_b = _numbered(a), _numbered(b)
    place = {key[0]: j for j, key in enumerate(keys_b)}
    shared = {key[0] for key in keys_a} & place.keys()
    out: Wrapper = []
    i = j = 0
    for x, y in [*_common(keys_a, keys_b), (len(a), len(b))]:
        for (label, flags, inner), (key,) in zip(a[i:x], keys_a[i:x]):
            if key in shared:  # stands elsewhere on the other side
                other = b[place[key]]
                flags, inner = flags | other[1], aligned(inner, other[2])
            out.append([label, flags | OPTIONAL, inner])
        out += [[label, flags | OPTIONAL, inner] for (label, flags, inner), (key,) in zip(b[j:y], keys_b[j:y]) if key not in shared]
        if x < len(a):
            out.append([a[x][0], a[x][1] | b[y][1], aligned(a[x][2], b[y][2])])
        i, j = x + 1, y + 1
    return out


def written(wrapper: Wrapper) -> str:
    """A wrapper as one line per item: its depth, flags and label."""
    lines, todo = [], [(0, item) for item in reversed(wrapper)]
    while todo:
        depth, (label, flags, inner) = todo.pop()
        lines.append(f"{depth} {flags} {label}")
        todo += [(depth + 1, item) for item in reversed(inner)]
    return "\n".join(lines)


def read_wrapper(text: str) -> Wrapper:
    """The wrapper that ``written`` wrote."""
    levels: list[Wrapper] = [[]]
    for line in text.split("\n") if text else []:
        depth, flags, label = line.split(" ", 2)
        item = [label, int(flags), []]
        del levels[int(depth) + 1 :]
        levels[-1].append(item)
        levels.append(item[2])
    return levels[0]


def _shortened(wrapper: Wrapper) -> Wrapper:
    """The wrapper with what repeats inside one page folded too."""
    return folded([[label, flags, _shortened(inner)] for label, flags, inner in wrapper])


def as_expression(wrapper: Wrapper) -> str:
    """The wrapper in the notation of regular expressions, for people."""
    marks = {0: "", 1: "?", 2: "+", 3: "*"}

    def text(items: Wrapper) -> str:
        return " ".join(
            "#" + marks[f & 3] if label == "#" else f"<{label}>({text(inner)}){marks[f & 3]}" for label, f, inner in items
        )

    return text(_shortened(wrapper))


class Matcher:
    """A wrapper ready to be matched with pages. Items are numbered in the order of the wrapper; 0 is the page itself."""

    def __init__(self, wrapper: Wrapper):
        self.labels, self.flags, self.above = ["", ], [0], [-1]
        # per item its children by label if repeated, else by label and number
        self.inside: list[dict] = [{}]
        todo = [(0, wrapper)]
        while todo:
            parent, items = todo.pop()
            numbers: dict[str, int] = {}
            for label, flags, inner in items:
                own = len(self.labels)
                numbers[label] = numbers.get(label, 0) + 1
                self.inside[parent][label if flags & REPEATED else (label, numbers[label])] = own
                self.labels.append(label)
                self.flags.append(flags)
                self.above.append(parent)
                self.inside.append({})
                if inner:
                    todo.append((own, inner))

    def slots(self, stream: list[str]) -> list[int]:
        """The slot of each text block of a page in order; -1 where the wrapper has none, which no page
        that took part in it sees."""
        found = []
        levels: list[tuple[int, dict]] = [(0, {})]
        for token in stream:
            if token == ">":
                levels.pop()
                continue
            label = token if token == "#" else token[1:]
            parent, numbers = levels[-1]
            item = -1
            if parent >= 0:
                item = self.inside[parent].get(label, -1)
                if item < 0:
                    numbers[label] = numbers.get(label, 0) + 1
                    item = self.inside[parent].get((label, numbers[label]), -1)
            if token == "#":
                found.append(item)
            else:
                levels.append((item, {}))
        return found

    def around(self, slots: list[int]) -> int | None:
        """The deepest element that holds all of these slots and more than one piece of text; None without slots."""
        if not slots:
            return None
        held = [0] * len(self.labels)
        for slot in slots:
            held[self.above[slot]] += 1
        # an item has a larger number than the one it stands in
        for item in range(len(held) - 1, 0, -1):
            held[self.above[item]] += held[item]
        item = max(k for k, n in enumerate(held) if n == len(slots))
        while item and self.labels[item].split(".")[0] in TEXT_ELEMENTS:
            item = self.above[item]
        return item

    def under(self, item: int) -> set[int]:
        """The item and all that stand in it."""
        found = {item}
        for k in range(item + 1, len(self.labels)):
            if self.above[k] in found:
                found.add(k)
        return found


@lru_cache(maxsize=1024)
def matcher(text: str) -> Matcher:
    return Matcher(read_wrapper(text))


def mostly_links(block: Block, text: str) -> bool:
    return block.links > 0.5 * max(1, len(text))


def _observed(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages): the pages (host, html) of a host that came in one batch, aligned."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        _go_deep()
        held: dict[str, list] = {}
        seen = set()
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            _, stream = blocks(page or "")
            one = held.setdefault(host, [None, 0])
            one[1] += 1
            key = (host, xxhash.xxh3_128_digest(" ".join(stream).encode("utf-8", "replace")))
            if key not in seen:
                seen.add(key)
                wrapper = wrapper_of(stream)
                one[0] = wrapper if one[0] is None else aligned(one[0], wrapper)
        columns = [
            pa.array(list(held), pa.string()),
            pa.array([written(w) for w, _ in held.values()], pa.string()),
            pa.array([n for _, n in held.values()], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["host", "wrapper", "pages"])

    return arrow_pass(pages.select("host", "html"), work, "host string, wrapper string, pages bigint")


def _merged(rows: DataFrame, *by: str) -> DataFrame:
    """(host, wrapper, pages): all wrappers of a group aligned one after the other, as a stream; one wrapper is held."""
    ordered = rows.repartition(*by).sortWithinPartitions(*by, "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _go_deep()
        held, wrapper, pages = None, [], 0

        def row() -> pa.RecordBatch:
            columns = [pa.array([held[0]]), pa.array([written(wrapper)]), pa.array([pages], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["host", "wrapper", "pages"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for host, text, n, *salt in zip(*columns):
                key = (host, *salt)
                if key != held:
                    if held is not None:
                        yield row()
                    held, wrapper, pages = key, read_wrapper(text), 0
                else:
                    wrapper = aligned(wrapper, read_wrapper(text))
                pages += n
        if held is not None:
            yield row()

    return ordered.mapInArrow(run, "host string, wrapper string, pages bigint")


def host_wrappers(observed: DataFrame) -> DataFrame:
    """(host, wrapper, pages): one wrapper per host from those of the batches."""
    salted = observed.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    return _merged(_merged(salted.select("host", "wrapper", "pages", "salt"), "host", "salt"), "host")


def _named(found: list[Block]) -> bool:
    """True if the page names its article by an article or main element."""
    return any(b.main and not b.outside for b in found)


def slot_sums(pages: DataFrame) -> DataFrame:
    """Per host, slot and whether pages name their article: sums over the text blocks of ``pages`` (host, html, wrapper).

    Blocks in marked elements are left out, and on pages that name their article all blocks outside it. ``pages`` has a
    bit for the digest of the blocks of every page: as many bits are as many different pages at least, however
    often each is repeated.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        _go_deep()
        sums: dict[tuple, list] = {}
        for host, page, wrapper in zip(*(batch.column(i).to_pylist() for i in range(3))):
            found, stream = blocks(page or "")
            named = _named(found)
            shown = [
                (slot, b, b.text())
                for slot, b in zip(matcher(wrapper).slots(stream), found)
                if not b.outside and (b.main or not named)
            ]
            digest = xxhash.xxh3_64_intdigest("\n".join(t for _, _, t in shown).encode("utf-8", "replace"))
            for slot, block, text in shown:
                mark = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 1
                row = sums.setdefault((host, named, slot), [0, 0, mark, mark, 0])
                row[0] += len(text)
                row[1] += len(text) if mostly_links(block, text) else 0
                row[2], row[3] = min(row[2], mark), max(row[3], mark)
                row[4] |= 1 << digest % 63
        keys = list(sums)
        columns = [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.bool_()),
            pa.array([k[2] for k in keys], pa.int32()),
            *(pa.array([sums[k][i] for k in keys], pa.int64()) for i in range(5)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["host", "named", "slot", "chars", "links", "low", "high", "pages"])

    schema = "host string, named boolean, slot int, chars bigint, links bigint, low bigint, high bigint, pages bigint"
    rows = arrow_pass(pages.select("host", "html", "wrapper"), work, schema)
    return rows.groupBy("host", "named", "slot").agg(
        F.sum("chars").alias("chars"), F.sum("links").alias("links"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("pages").alias("pages"),
    )


def _is_constant(row: dict) -> bool:
    return row["low"] == row["high"] and row["pages"].bit_count() >= CONSTANT_PAGES


def decided(text: str, rows: list[dict]) -> str:
    """The written wrapper with the decision on every text slot in its flags, from the sums of the slots.

    4: part of the article on pages that name it. A slot with one text is not, unless it is a heading or such
    slots hold most of the article's text, which is what versions of one article look like.
    8: part of the article on other pages. It is the deepest element with all text that differs between
    pages and is not links, without the slots that have one text.
    """
    m = matcher(text)
    flags: dict[int, int] = defaultdict(int)
    named = [r for r in rows if r["named"] and r["slot"] > 0]
    fixed = [r for r in named if _is_constant(r) and m.labels[m.above[r["slot"]]].split(".")[0] not in HEADINGS]
    template = {r["slot"] for r in fixed}
    if 2 * sum(r["chars"] for r in fixed) >= sum(r["chars"] for r in named):
        template = set()
    for r in named:
        if r["slot"] not in template:
            flags[r["slot"]] |= ARTICLE
    others = [r for r in rows if not r["named"] and r["slot"] > 0 and not _is_constant(r)]
    around = m.around([r["slot"] for r in others if r["chars"] > r["links"]])
    inside = m.under(around) if around is not None else set()
    for r in others:
        if r["slot"] in inside:
            flags[r["slot"]] |= PLACE
    return _with_flags(text, m, flags)


def _with_flags(text: str, m: Matcher, flags: dict[int, int]) -> str:
    """The written wrapper with these flags added to its items, which are numbered as the matcher does."""
    wrapper = read_wrapper(text)
    number, todo = 1, [wrapper]
    while todo:
        items = todo.pop()
        for item in items:
            item[1] |= flags.get(number, 0)
            number += 1
            if item[2]:
                todo.append(item[2])
    return written(wrapper)


def article_text(page: str | None, rule: str | None) -> str:
    """The main text of one page under the decided wrapper of its host; empty if there is none.

    Blocks in marked elements never belong to it. Of a page that names its article, the blocks of it go by the flag 4
    of their slots; of another one all blocks go by 8, and what is mostly links on this page goes. Without a
    wrapper, or if it keeps nothing of the page, these hints decide alone.
    """
    found, stream = blocks(page or "")
    named = _named(found)
    slots = matcher(rule).slots(stream) if rule else [-1] * len(found)
    shown = [(s, b) for s, b in zip(slots, found) if not b.outside and (b.main or not named)]
    if not named:
        shown = [(s, b) for s, b in shown if not mostly_links(b, b.text())]
    if rule:
        flags, wanted = matcher(rule).flags, ARTICLE if named else PLACE
        shown = [(s, b) for s, b in shown if s >= 0 and flags[s] & wanted] or shown
    return " ".join(t for t in (b.text() for _, b in shown) if t)


def host_rules(pages: DataFrame) -> DataFrame:
    """(host, rule) for the hosts of ``pages`` (host, html) with CONSTANT_PAGES pages or more: their decided wrappers."""
    wrappers = settled(host_wrappers(_observed(pages)).where(F.col("pages") >= CONSTANT_PAGES).select("host", "wrapper"))
    sums = slot_sums(pages.select("host", "html").join(small_side(wrappers), "host"))
    # one entry per text slot of the host's wrapper, however many pages it has
    slots = sums.groupBy("host").agg(F.collect_list(F.struct("named", "slot", "chars", "links", "low", "high", "pages")).alias("slots"))
    both = wrappers.join(slots, "host")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        _go_deep()
        rules = [decided(w, rows) for w, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rules, pa.string())], ["host", "rule"])

    return settled(arrow_pass(both.select("host", "wrapper", "slots"), work, "host string, rule string"))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``.

    Null and empty pages have an empty text; pages with a null url or one without a host share a wrapper.
    Repeated pages are extracted alike; other columns are not read. An empty table gives an empty table.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    slim = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    slim = slim.join(small_side(host_rules(slim)), "host", "left")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        _go_deep()
        texts = [article_text(page, rule) for page, rule in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    schema = f"page_id {kind}, url string, text string, n_chars bigint"
    return arrow_pass(slim.select("page_id", "url", "html", "rule"), work, schema)

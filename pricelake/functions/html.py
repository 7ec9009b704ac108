"""Helpers for the two HTML passes (stored pages, search-result pages).

Spark partitions the rows; each call sees one page. A small tree is needed because headings, main
content and result blocks depend on nesting.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import parse_qs, unquote, urljoin, urlparse

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "template"}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        stack = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, Node):
                yield item
                stack.extend(reversed(item.children))

    def strings(self):
        stack = [(c, self.tag in _HIDDEN) for c in reversed(self.children)]
        while stack:
            item, hidden = stack.pop()
            if isinstance(item, str):
                if not hidden:
                    yield item
            else:
                stack.extend((c, item.tag in _HIDDEN) for c in reversed(item.children))

    def text(self):
        return "".join(s for s in (t.strip() for t in self.strings()) if s)

    def ancestor(self, tag):
        node = self.parent
        while node is not None and node.tag != tag:
            node = node.parent
        return node


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("[document]", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.top)
        self.top.children.append(node)
        if tag not in _VOID:
            self.top = node

    def handle_endtag(self, tag):
        node = self.top
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.top = node.parent

    def handle_data(self, data):
        if self.top.children and isinstance(self.top.children[-1], str):
            self.top.children[-1] += data
        else:
            self.top.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


FIELDS = ("title", "full_text", "main_content", "headers", "meta_tags", "images", "json_ld", "links")


def _absolute(url: str, href: str) -> str | None:
    try:
        return urljoin(url, href)
    except ValueError:
        return None


def page_fields(url: str, html: str, wanted=FIELDS) -> dict:
    """The wanted stored fields of one page; what is not wanted is not computed."""
    root = parse(html)
    nodes = list(root.walk())
    own_text = lambda node: "".join(c for c in node.children if isinstance(c, str))
    first = lambda tag: next((n for n in nodes if n.tag == tag), None)
    name_of = lambda n: n.attrs.get("name", n.attrs.get("property", ""))

    def title():
        node = first("title")
        return own_text(node).strip() if node else None

    def main_content():
        body = first("main") or first("article")
        return body.text() if body else ""

    makers = {
        "title": title,
        "full_text": root.text,
        "main_content": main_content,
        "headers": lambda: {tag: [n.text() for n in nodes if n.tag == tag] for tag in ("h1", "h2", "h3")},
        "meta_tags": lambda: {name_of(n): n.attrs.get("content", "") for n in nodes if n.tag == "meta" and name_of(n)},
        "images": lambda: [{k: n.attrs.get(k, "") for k in ("src", "alt", "title")} for n in nodes if n.tag == "img"],
        "json_ld": lambda: [own_text(n) for n in nodes if n.tag == "script" and n.attrs.get("type") == "application/ld+json"],
        "links": lambda: [x for x in (_absolute(url, n.attrs["href"]) for n in nodes if n.tag == "a" and "href" in n.attrs) if x is not None],
    }
    return {name: makers[name]() for name in wanted}


# ---- fixed values: where each engine puts its results --------------------------------------
# selectors are (tag or None, attribute, pattern, whole token); the first that finds something wins
_LAYOUT = {
    "startpage": {
        "blocks": [("div", "class", r"w-gl__result", False), ("section", "class", r"w-gl__result", False)],
        "title": [("a", "class", r"w-gl__result-title", False), ("h3", "class", r"w-gl__result-title", False),
                  ("a", "class", r"result-link|title", False)],
        "text": [("p", "class", r"w-gl__description", False), (None, "class", r"description|snippet", False)],
        "own": None,
    },
    "ecosia": {
        "blocks": [(None, "data-test-id", r"mainline-result|web-result", False),
                   ("div", "class", r"result__body|result-card|web-result", False),
                   ("article", "class", r"result", False)],
        "title": [("a", "class", r"result__title|result-title", False), ("h2", None, None, False), ("h3", None, None, False)],
        "text": [(None, "class", r"result__snippet|result-snippet|description", False), ("p", None, None, False)],
        "own": "ecosia.org",
    },
    "qwant": {
        "blocks": [(None, "data-testid", r"webResult|result", False),
                   ("div", "class", r"result(?!-page)|web-result", False), ("article", None, None, False)],
        "title": [("a", "data-testid", r"serTitle", True), ("h2", None, None, False), ("h3", None, None, False),
                  ("a", "class", r"title|heading", False)],
        "text": [(None, "data-testid", r"serDescription", True), (None, "class", r"description|snippet|abstract", False),
                 ("p", None, None, False)],
        "own": "qwant.com",
    },
    "google": {
        "blocks": [("div", "class", r"g\b|yuRUbf", False), ("div", "data-ved", None, False)],
        "text": [("span", "class", r"st|s3v9rd", False)],
    },
}


def _matches(node: Node, selector) -> bool:
    tag, attribute, pattern, whole = selector
    if tag is not None and node.tag != tag:
        return False
    if attribute is None:
        return True
    if attribute not in node.attrs:
        return False
    if pattern is None:
        return True
    value = node.attrs[attribute]
    values = value.split() + [value] if attribute == "class" else [value]
    return any(v == pattern if whole else re.search(pattern, v) for v in values)


def _find(node: Node, selectors):
    for selector in selectors:
        for child in node.walk():
            if _matches(child, selector):
                return child
    return None


def _link_in(node: Node):
    return _find(node, [("a", "href", None, False)])


def _unwrap(href: str, key: str):
    values = parse_qs(urlparse(href).query).get(key)
    return values[0] if values else None


def _hit(stage, title, url, description=None):
    return {"stage": stage, "title": title, "url": url, "description": description}


def _block_hits(engine: str, root: Node):
    layout = _LAYOUT[engine]
    blocks = []
    for selector in layout["blocks"]:
        blocks = [n for n in root.walk() if _matches(n, selector)]
        if blocks:
            break
    for block in blocks:
        if engine == "google":
            heading = _find(block, [("h3", None, None, False)])
            link = heading.ancestor("a") if heading else _link_in(block)
            if link is None:
                continue
            title, url = link.text(), link.attrs.get("href")
            if url and url.startswith("/url?"):
                url = _unwrap(url, "url")
        else:
            head = _find(block, layout["title"])
            if head is None:
                head = _link_in(block)
                if head is None:
                    continue
            title, url = head.text(), head.attrs.get("href")
            if head.tag in ("h2", "h3"):
                inside = _link_in(head) if engine != "startpage" else None
                link = inside or head.ancestor("a")
                if link is None and engine == "startpage":
                    link = _link_in(block)
                elif link is None:
                    continue
                url = link.attrs.get("href") if link else None
            if layout["own"] and url and (layout["own"] in url or url.startswith("/")):
                continue
        note = _find(block, layout["text"])
        yield _hit(0, title, url, note.text() if note else None)


def _loose_hits(engine: str, root: Node):
    own = _LAYOUT[engine]["own"]
    links = [n for n in root.walk() if n.tag == "a" and "href" in n.attrs]
    for link in links:
        url, title = link.attrs["href"], link.text()
        if url.startswith("http") and own not in url and 5 < len(title) < 200:
            yield _hit(1, title, url)


def _startpage_headings(root: Node):
    for heading in [n for n in root.walk() if n.tag == "h3"]:
        link = _link_in(heading) or heading.ancestor("a")
        if link is not None:
            url = link.attrs.get("href")
            if not (url and "startpage.com" in url):
                yield _hit(1, heading.text() or link.text(), url)


def _duckduckgo_url(href: str, bare: bool):
    if "uddg=" in href:
        target = _unwrap(href, "uddg")
        return unquote(target) if target else None
    if href.startswith("http"):
        return href
    return "https:" + href if bare and href.startswith("//") else None


def _duckduckgo_hits(root: Node):
    order = list(root.walk())
    place = {id(n): i for i, n in enumerate(order)}
    titles = [n for n in order if _matches(n, ("a", "class", "result__a", True))]
    for link in titles:
        after = order[place.get(id(link.parent), -1) + 1 :]
        note = next((n for n in after if _matches(n, ("a", "class", "result__snippet", True))), None)
        note = note or next((n for n in after if _matches(n, (None, "class", "result__snippet", False))), None)
        yield _hit(0, link.text(), _duckduckgo_url(link.attrs.get("href", ""), True), note.text() if note else None)
    for heading in [n for n in order if n.tag == "h2"]:
        link = _link_in(heading)
        if link is not None:
            yield _hit(1, link.text(), _duckduckgo_url(link.attrs["href"], False))


def result_hits(engine: str, html: str) -> dict:
    """Hits of a result page by stage (0 blocks, 1 looser rule) and the page text for the last resort."""
    root = parse(html)
    if engine == "duckduckgo":
        hits = list(_duckduckgo_hits(root))
    elif engine in _LAYOUT:
        hits = list(_block_hits(engine, root))
        if engine == "startpage":
            hits += _startpage_headings(root)
        elif engine != "google":
            hits += _loose_hits(engine, root)
    else:
        hits = []
    least = 1 if engine == "google" else 3
    hits = [h for h in hits if h["url"] and len(h["title"]) >= least]
    return {"hits": hits, "text": "".join(root.strings()) if engine != "google" else None}

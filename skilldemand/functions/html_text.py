"""Elements and text nodes of HTML, for use inside Pandas UDFs."""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser

VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Text below these tags is not document text.
HIDDEN_TAGS = frozenset(["script", "style", "template", "rt", "rp"])
# Blank runs below these tags are kept as they are.
VERBATIM_TAGS = frozenset(["pre", "textarea"])
BLANKS = " \n\t\f\r"


@dataclass
class Element:
    """A tag; its descendants and texts are ranges in the document's two lists."""

    tag: str
    attrs: dict[str, str]
    first_child: int
    first_text: int
    end_child: int = -1
    end_text: int = -1

    def class_has(self, part: str) -> bool:
        return part in self.attrs.get("class", "").lower()


class Document(HTMLParser):
    """Markup as flat lists of elements and text nodes in document order.

    A marked section that the parser does not know is an error, or with ``lenient`` a
    comment.
    """

    def __init__(self, markup: str, lenient: bool = False):
        super().__init__(convert_charrefs=True)
        self._lenient = lenient
        self.elements: list[Element] = []
        self.texts: list[str] = []
        self._open: list[Element] = []
        self._run: list[str] = []
        self.feed(markup)
        self.close()
        self._end_run()
        while self._open:
            self._close_last()

    def _is_below(self, tags: frozenset) -> bool:
        return any(e.tag in tags for e in self._open)

    def _end_run(self):
        text = "".join(self._run)
        self._run = []
        if not text or self._is_below(HIDDEN_TAGS):
            return
        if not text.strip(BLANKS) and not self._is_below(VERBATIM_TAGS):
            text = "\n" if "\n" in text else " "
        self.texts.append(text)

    def _close_last(self):
        element = self._open.pop()
        element.end_child, element.end_text = len(self.elements), len(self.texts)
        return element.tag

    def handle_starttag(self, tag, attrs):
        self._end_run()
        named = {name: value or "" for name, value in reversed(attrs)}
        self.elements.append(Element(tag, named, len(self.elements) + 1, len(self.texts)))
        self._open.append(self.elements[-1])
        if tag in VOID_TAGS:
            self._close_last()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._close_last()

    def handle_endtag(self, tag):
        self._end_run()
        if any(e.tag == tag for e in self._open):
            while self._close_last() != tag:
                pass

    def handle_data(self, data):
        self._run.append(data)

    def handle_comment(self, data):
        self._end_run()

    def handle_decl(self, decl):
        self._end_run()

    def handle_pi(self, data):
        self._end_run()

    def unknown_decl(self, data):
        self._end_run()
        if data.upper().startswith("CDATA["):
            self._run.append(data[6:])
            self._end_run()

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            if not self._lenient:
                raise
            return self.parse_bogus_comment(i)

    def below(self, element: Element) -> list[Element]:
        return self.elements[element.first_child : element.end_child]

    def text(self, element: Element, separator: str = "") -> str:
        """Trimmed text nodes of an element."""
        nodes = map(str.strip, self.texts[element.first_text : element.end_text])
        return separator.join(node for node in nodes if node)


def text_of(markup: str, strip: bool = False, lenient: bool = False) -> str:
    """Text nodes joined by a space; ``strip`` trims each node and drops blank ones."""
    nodes = Document(markup, lenient).texts
    if strip:
        nodes = [node for node in map(str.strip, nodes) if node]
    return " ".join(nodes)

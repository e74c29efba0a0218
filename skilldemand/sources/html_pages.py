"""Search result pages (HTML) to postings."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilldemand.functions.dates import iso_utc
from skilldemand.functions.html_text import Document, Element
from skilldemand.functions.isolate import message

_CARD = (
    "role_category string, title string, company string, location string, "
    "url string, raw_text string, posted string, error string"
)

# Source name and base address of this board.
SOURCE = "reed"
BASE_URL = "https://www.reed.co.uk"


def parse_html_pages(pages: DataFrame, base_url: str = BASE_URL, source: str = SOURCE) -> DataFrame:
    """Job cards of pages (role_category, html); cards without title or address are dropped.

    Pages are dealt over the tasks by a hash of their text first, as a file of small pages is
    often read by one task. A page that can't be parsed has no cards;
    ``parse_html_pages_checked`` tells which.
    """
    return parse_html_pages_checked(pages, base_url, source).where("error IS NULL").drop("error")


def parse_html_pages_checked(pages: DataFrame, base_url: str = BASE_URL, source: str = SOURCE) -> DataFrame:
    """The same with ``error``: a page that fails is one row with the message and its role."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [field.split()[0] for field in _CARD.split(", ")]
        for batch in batches:
            rows = []
            for role, html in zip(batch["role_category"], batch["html"]):
                try:
                    rows += [(role, *card, None) for card in list(job_cards(html or "", base_url))]
                except Exception as exc:
                    rows.append((role, *[None] * (len(columns) - 2), message(exc)))
            yield pd.DataFrame(rows, columns=columns)

    cards = pages.select("role_category", "html").repartition("html").mapInPandas(parse, _CARD)
    return cards.select(
        F.lit(source).alias("source"),
        "role_category",
        "title",
        "company",
        "location",
        "url",
        "raw_text",
        iso_utc(F.col("posted")).alias("posted_at"),
        "error",
    )


def job_cards(html: str, base_url: str) -> Iterator[tuple]:
    """(title, company, location, url, text, posted) of each usable card."""
    page = Document(html, lenient=True)
    for card in page.elements:
        if card.tag == "article" and card.attrs.get("data-qa") == "job-card":
            inside = page.below(card)
            link = _title_link(page, inside)
            title = page.text(link) if link else ""
            href = link.attrs.get("href", "") if link else ""
            url = urljoin(base_url, href) if href else ""
            if title and url:
                time = _first(inside, lambda e: e.tag == "time")
                text = _first(inside, lambda e: e.tag in ("div", "p") and e.class_has("description"))
                yield (
                    title,
                    _company(page, inside),
                    _location(page, inside),
                    url,
                    page.text(text, " ") if text else "",
                    (time.attrs.get("datetime") or None) if time else None,
                )


def _first(elements: list[Element], test) -> Element | None:
    return next(filter(test, elements), None)


def _title_link(page: Document, inside: list[Element]) -> Element | None:
    heading = _first(inside, lambda e: e.tag == "h2")
    links = [e for e in inside if e.tag == "a"]
    return (
        _first(links, lambda a: a.attrs.get("data-qa") == "job-card-title")
        or _first(links, lambda a: a.attrs.get("data-element") == "job_title")
        or (heading and _first(page.below(heading), lambda e: e.tag == "a"))
        or _first(links, lambda a: a.class_has("title"))
    )


def _company(page: Document, inside: list[Element]) -> str:
    def employer_link(e: Element) -> bool:
        href = e.attrs.get("href", "")
        return (
            e.tag == "a"
            and href.startswith("/jobs/")
            and "/p" in href
            and e.attrs.get("data-qa") != "job-card-title"
            and page.text(e) != ""
        )

    found = (
        _first(inside, lambda e: e.tag == "a" and e.class_has("recruiter"))
        or _first(inside, lambda e: e.tag == "span" and e.class_has("recruiter"))
        or _first(inside, employer_link)
    )
    return page.text(found) if found else "Unknown"


def _location(page: Document, inside: list[Element]) -> str:
    found = _first(inside, lambda e: e.tag == "li" and e.class_has("location"))
    if found is None:
        listed = {id(e): e for ul in inside if ul.tag == "ul" for e in page.below(ul) if e.tag == "li"}
        items = list(listed.values())
        found = items[1] if len(items) > 1 else None
    return page.text(found) if found else ""

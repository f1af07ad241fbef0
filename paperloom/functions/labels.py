"""Ordered rules that turn labels, states and texts into categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.cells import let, strip

# Layout labels by kind, in the order in which they are tried; a text alone is a part of the label.
REGION_RULES = (
    ("title", ("doc_title", "document_title", "title")),
    ("section", ("paragraph_title", "section_title", "section_header", "heading")),
    ("authors", ("author", "authors")),
    ("list", ("list", "list_item")),
    ("caption", ("caption", "figure_title", "image_caption", "chart_title", "table_title")),
    ("footnote", ("footnote", "vision_footnote")),
    ("formula", "formula"),
    ("table", "table"),
    ("figure", ("image", "figure", "chart", "seal")),
    ("header", ("header", "page_header")),
    ("footer", ("footer", "page_footer", "page_number")),
    ("text", ("text", "paragraph", "content", "abstract", "aside_text", "reference")),
)
# Names under which document styles are asked for.
SPEC_ALIASES = {
    "plain": (
        "plain", "business_document", "business", "corporate", "company_document", "general", "generic", "standard", "document", "surat", "memo",
        "pengumuman", "text", "teks",
    ),
    "markdown_hierarchy": (
        "markdown_hierarchy", "structured_document", "structured", "hierarchy", "heading", "sop", "sk", "policy", "kebijakan", "peraturan",
        "perjanjian", "legal", "report", "laporan",
    ),
    "bilingual_journal": (
        "bilingual_journal", "multi_column_document", "multi_column", "multicolumn", "two_column", "2_column", "two_col", "2_col", "column", "kolom",
        "dua_kolom", "2_kolom", "article", "artikel", "newsletter", "bulletin", "buletin", "journal", "academic", "bilingual",
    ),
    "presentation_slides": (
        "presentation_slides", "presentation", "slide", "slides", "ppt", "pptx", "deck", "sosialisasi", "training",
    ),
    "chat_transcript": (
        "chat_transcript", "chat", "whatsapp", "wa", "telegram", "line", "conversation", "percakapan", "chat_screenshot",
    ),
    "signature_form": (
        "signature_form", "signature", "tanda_tangan", "ttd", "paraf", "approval", "approve", "persetujuan", "form", "formulir",
    ),
}
# Diagram types, and the substrings that lead to one, in order.
DIAGRAM_TYPES = (
    "flowchart", "sequence_diagram", "class_diagram", "state_diagram", "er_diagram", "mindmap", "gantt_chart", "block_architecture", "pin_diagram",
    "memory_map", "circuit_diagram", "timing_diagram", "git_graph", "generic_diagram", "unsuitable_statistical_chart", "unsuitable_map_or_spatial",
    "unsuitable_photo_or_illustration", "unsuitable_complex_schematic", "non_diagram",
)
DIAGRAM_HINTS = (
    (("pin",), "pin_diagram"), (("memory", "register", "map"), "memory_map"), (("flow",), "flowchart"), (("block", "arch"), "block_architecture"),
    (("seq",), "sequence_diagram"), (("circuit", "skema"), "circuit_diagram"), (("time", "timing"), "timing_diagram"),
)
FLOW_MARKERS = ("flowchart", "workflow", "swimlane", "decision_tree", "alur_proses")
ACTIVE, FAILED = ("queued", "running", "paused"), ("failed", "canceled")


def _contains_any(x: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [x.contains(w) for w in words])


def layout_kind(label: Column) -> Column:
    """The kind of a layout region by its label."""
    x = F.regexp_replace(F.lower(F.trim(label)), "[- ]", "_")
    out = None
    for kind, names in REGION_RULES:
        hit = x.contains(names) if isinstance(names, str) else x.isin(*names)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")


def region_kind(label: Column, text: Column) -> Column:
    """table, figure, text or unknown by label and content."""
    a, t = F.lower(F.trim(F.coalesce(label, F.lit("")))), F.lower(F.trim(F.coalesce(text, F.lit(""))))
    pipes = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    table = _contains_any(a, ("table", "tabel")) | (pipes >= 4) | _contains_any(t, ("<table", "</table>"))
    figure = _contains_any(a, ("figure", "image", "diagram", "chart", "visual", "gambar")) | _contains_any(t, ("[diagram/visual]", "[gambar/visual]", "```mermaid"))
    return F.when(table, "table").when(figure, "figure").when(_contains_any(a, ("text", "title", "heading", "paragraph")), "text").otherwise("unknown")


def scaled_box(box: Column, width: Column, height: Column, scale: int = 1024) -> Column:
    """A model's box on a scale of ``scale`` as pixels inside the image; null where nothing is left."""
    at = lambda k, size: F.greatest(F.lit(0), F.least(F.bround(box[k] / F.lit(float(max(1, scale))) * size, 0).cast("int"), size))
    left, top, right, bottom = at(0, width), at(1, height), at(2, width), at(3, height)
    return F.when((right > left) & (bottom > top), F.array(left, top, right, bottom))


_GROUNDING = r"(?s)<\|ref\|>(.*?)<\|/ref\|>\s*<\|det\|>\s*\[\[\s*([\d.]+)\s*,\s*([\d.]+)\s*,\s*([\d.]+)\s*,\s*([\d.]+)\s*\]\]\s*<\|/det\|>((?:(?!<\|ref\|>).)*)"


def grounded_regions(raw: Column, width: Column, height: Column, scale: int = 1024) -> Column:
    """Regions in a model's tagged answer: array of (label, text, bbox_model, bbox_pixels); boxes without area are left out."""
    hits = F.regexp_extract_all(raw, F.lit("(" + _GROUNDING + ")"), F.lit(1))

    def read(h: Column) -> Column:
        part = lambda k: F.regexp_extract(h, _GROUNDING, k)
        box = F.array(*[part(k).try_cast("double") for k in (2, 3, 4, 5)])
        label = F.coalesce(F.nullif(strip(part(1)), F.lit("")), F.lit("unknown"))
        return F.struct(label.alias("label"), strip(part(6)).alias("text"), box.alias("bbox_model"), scaled_box(box, width, height, scale).alias("bbox_pixels"))

    return F.filter(F.transform(hits, read), lambda r: r["bbox_pixels"].isNotNull())


def normalize_specs(c: Column) -> Column:
    """Asked-for styles as an ordered array of canonical ones; plain if none is known."""
    alias = F.create_map(*[F.lit(x) for spec, names in SPEC_ALIASES.items() for name in names for x in (name, spec)])
    token = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9_]+", "_"), r"^_+|_+$", "")
    tokens = F.concat(F.array(token(F.trim(c))), F.transform(F.split(F.lower(F.trim(c)), r"[,;|+/\s]+"), token))
    found = F.array_distinct(F.filter(F.transform(tokens, lambda t: F.try_element_at(alias, t)), lambda s: s.isNotNull()))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit("plain"))))


def diagram_type(c: Column) -> Column:
    """A free diagram name as one of the known types."""
    x = F.lower(F.trim(c))
    out = F.when(x.isNull() | (x == ""), "generic_diagram").when(x.isin(*DIAGRAM_TYPES), x)
    for words, kind in DIAGRAM_HINTS:
        out = out.when(_contains_any(x, words), kind)
    return out.otherwise("generic_diagram")


def policy_diagram_type(c: Column) -> Column:
    """Flow charts by any of their names; other names in snake case."""
    x = F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")
    return F.when(_contains_any(x, FLOW_MARKERS), "flowchart").otherwise(x)


def diagram_advice(c: Column) -> Column:
    """struct(diagram_type, recommended_format, is_mermaid_compatible): only flow charts become code."""

    def advise(kind: Column) -> Column:
        flow = kind == "flowchart"
        return F.struct(kind.alias("diagram_type"), F.when(flow, "mermaid_code").otherwise("text_description").alias("recommended_format"), flow.alias("is_mermaid_compatible"))

    return let(let(policy_diagram_type(c), diagram_type), advise)


def progress(status: Column, current: Column, total: Column) -> Column:
    """Per cent done: 100 when completed, within 1 to 98 while pages are counted, 5 when only running."""
    share = F.bround(current / total * 100.0, 1)
    return (
        F.when(status == "completed", 100.0).when((total > 0) & (current > 0), F.least(F.lit(98.0), F.greatest(F.lit(1.0), share)))
        .when(status == "running", 5.0).otherwise(0.0)
    )


def batch_state(any_active: Column, any_failed: Column, n: Column) -> Column:
    """The state of a batch: not begun, in work, to be looked at, done."""
    return F.when(n == 0, "Belum dimulai").when(any_active, "Diproses").when(any_failed, "Perlu diperiksa").otherwise("Selesai")

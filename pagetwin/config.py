"""Settings of a comparison and how overrides are merged into them."""

from __future__ import annotations

import copy
from typing import Any

# They must equal the published defaults for results to agree.
INDEX_FILES = ["index.html", "index.htm", "index.php", "default.aspx", "default.htm"]
SKIP_EXTENSIONS = [
    "pdf", "zip", "gz", "rar", "7z", "exe", "dmg", "msi", "jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "ico", "bmp", "tif", "tiff", "mp3",
    "mp4", "m4a", "mov", "avi", "webm", "ogg", "wav", "css", "js", "mjs", "json", "xml", "rss", "atom", "txt", "csv", "xls", "xlsx", "doc", "docx",
    "ppt", "pptx", "woff", "woff2", "ttf", "otf", "eot",
]
REMOVED_SELECTORS = [
    "script", "style", "noscript", "template", "svg", "[data-pagetwin-ignore]", "#onetrust-consent-sdk", "#CybotCookiebotDialog",
    ".cookie-banner", ".cookie-consent", "#cookie-banner", "#cookie-notice", ".cc-window",
]
TEXT_PATTERNS = [
    {"name": "iso-timestamp", "mode": "ignore", "pattern": r"\b\d{4}-\d{2}-\d{2}[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s?(Z|[+-]\d{2}:?\d{2}|UTC|GMT)?"},
    {"name": "clock-time-seconds", "mode": "ignore", "pattern": r"\b\d{1,2}:\d{2}:\d{2}(\.\d+)?\s?([ap]\.?m\.?)?(\s?(UTC|GMT|[A-Z]{2,4}T))?(?![\w])", "flags": "i"},
    {"name": "clock-time", "mode": "cosmetic", "pattern": r"\b\d{1,2}:\d{2}\s?([ap]\.?m\.?)?(\s?(UTC|GMT|[A-Z]{2,4}T))?(?![\w])", "flags": "i"},
    {"name": "relative-time", "mode": "ignore", "pattern": r"\b(\d+|an?|one)\s+(second|minute|hour|day|week|month|year)s?\s+ago\b|\bjust now\b", "flags": "i"},
    {"name": "uuid", "mode": "ignore", "pattern": r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "flags": "i"},
    {"name": "hex-token", "mode": "ignore", "pattern": r"\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{16,}\b", "flags": "i"},
    {"name": "copyright-year", "mode": "ignore", "pattern": r"(©|&copy;|\(c\)|copyright)\s*\d{4}(\s*[-–]\s*\d{4})?", "flags": "i"},
    {
        "name": "date",
        "mode": "cosmetic",
        "pattern": r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[/.]\d{1,2}[/.]\d{2,4}\b"
        r"|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+\d{1,2}(st|nd|rd|th)?,?\s+\d{4}\b"
        r"|\b\d{1,2}(st|nd|rd|th)?\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?,?\s+\d{4}\b",
        "flags": "i",
    },
]
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "dclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "_ga",
    "_gl", "yclid", "igshid", "ref", "ref_src", "hsa_*", "_hs*", "v", "ver", "version", "cb", "_", "cachebuster", "ts", "t",
]
URL_PATTERNS = ["/wp-admin", "/wp-login", "/cdn-cgi/", "/cart", "/checkout", "/login", "/logout", "/signin", "/signout", "/account", "/search"]
IMAGE_NAME_PATTERNS = [r"[-_.][0-9a-f]{6,}(?=\.[a-z0-9]+$)", r"-\d{2,4}x\d{2,4}(?=\.[a-z0-9]+$)", r"@[23]x(?=\.[a-z0-9]+$)"]
SIGNIFICANCE = ["error", "missing", "changed", "added", "structural", "cosmetic"]
CATEGORIES = ["page", "metadata", "headings", "structure", "text", "links", "images", "forms", "cta", "visual"]
CATEGORY_LABELS = ["Page", "Metadata", "Headings", "Page structure", "Text content", "Links", "Images", "Forms", "Calls to action", "Visual appearance"]

DEFAULTS: dict[str, Any] = {
    "crawl": {
        "maxPages": 100,
        "maxDepth": 10,
        "useSitemap": True,
        "maxProbes": 200,
        "wwwEquivalent": True,
        "keepQueryParams": [],
        "indexFiles": INDEX_FILES,
        "skipExtensions": SKIP_EXTENSIONS,
    },
    "http": {"userAgent": "pagetwin/0.1", "respectRobotsTxt": True, "delayMs": 500, "timeoutMs": 20000, "retries": 2, "maxRedirects": 10, "maxBodyBytes": 5 * 1024 * 1024},
    "render": {"mode": "auto", "minStaticTextChars": 200},
    "visual": {"enabled": False, "maxPages": 50, "maxHeight": 6000, "pixelThreshold": 0.1, "ignoreBelowPct": 0.5, "cosmeticBelowPct": 5},
    "ignore": {
        "selectors": REMOVED_SELECTORS,
        "extraSelectors": [],
        "textPatterns": TEXT_PATTERNS,
        "extraTextPatterns": [],
        "trackingParams": TRACKING_PARAMS,
        "urlPatterns": URL_PATTERNS,
        "extraUrlPatterns": [],
        "imageNamePatterns": IMAGE_NAME_PATTERNS,
        "ignoreHiddenFormFields": True,
        "caseAndPunctuationIsCosmetic": True,
        "skipCategories": [],
    },
    "compare": {"textSimilarityForChange": 0.45, "renameSimilarity": 0.6, "siteWide": {"minPages": 3, "minFraction": 0.3}},
    "output": {"dir": "reports", "subfolderPerRun": True, "labelA": "Site A", "labelB": "Site B", "writeJson": True, "maxDiffsPerCategory": 150},
}


def merge_config(base: Any, override: Any) -> Any:
    """Objects merge key by key, anything else replaces; None keeps the base."""
    if override is None:
        return copy.deepcopy(base)
    if not (isinstance(base, dict) and isinstance(override, dict)):
        return copy.deepcopy(override)
    merged = copy.deepcopy(base)
    merged.update({k: merge_config(base.get(k), v) if k in base else copy.deepcopy(v) for k, v in override.items()})
    return merged


def build_config(*overrides: Any) -> dict[str, Any]:
    """Defaults with the overrides in order, and the lists that join each setting with its `extra` one."""
    cfg = copy.deepcopy(DEFAULTS)
    for o in overrides:
        cfg = merge_config(cfg, o)
    ignore = cfg["ignore"]
    for name in ("Selectors", "TextPatterns", "UrlPatterns"):
        ignore[f"all{name}"] = ignore[name[0].lower() + name[1:]] + ignore[f"extra{name}"]
    return cfg

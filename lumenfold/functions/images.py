"""Barcode payloads and the screenshot heuristic, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display resolutions, either way round.
RESOLUTIONS = [(1920, 1080), (2560, 1440), (3840, 2160), (2880, 1800), (3024, 1964), (3456, 2234), (2560, 1600), (1366, 768), (1440, 900), (1600, 900), (1280, 720), (1280, 800), (1536, 864), (1920, 1200), (2256, 1504), (3000, 2000), (3840, 2400), (5120, 2880), (1170, 2532), (1179, 2556), (1290, 2796), (1080, 2400), (1080, 2340), (1440, 3120)]
# Words in names and paths of screenshots.
SCREENSHOT_WORDS = ["screenshot", "screen shot", "screen_shot", "screengrab", "screen grab", "screen_grab", "capture", "snip", "snipping", "printscreen", "prtscn", "cleanshot", "lightshot", "greenshot", "gyazo", "sharex"]
# Prefixes and parts that tell a payload's kind.
CRYPTO = ["bitcoin:", "ethereum:", "solana:", "litecoin:", "bitcoincash:", "dogecoin:"]
PAY_HOSTS = ["paypal.me/", "venmo.com/", "cash.app/$", "revolut.me/", "pay.google.com", "paytm.me/"]


def _starts(c: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def payload_tag(payload: Column) -> Column:
    trimmed = F.regexp_replace(payload, r"^\s+|\s+$", "")
    low = F.lower(trimmed)
    pays = F.lit(False)
    for h in PAY_HOSTS:
        pays = pays | low.contains(h)
    return (
        F.when(low.startswith("upi://") | (trimmed.startswith("000201") & (F.octet_length(payload) >= 20)) | _starts(low, CRYPTO) | pays, "qr:payment")
        .when(_starts(low, ["wifi:", "wifi;"]), "qr:wifi")
        .when(_starts(low, ["begin:vcard", "mecard:", "bizcard:"]), "qr:contact")
        .when(_starts(low, ["mailto:", "matmsg:"]), "qr:email")
        .when(low.startswith("tel:"), "qr:tel")
        .when(_starts(low, ["sms:", "smsto:"]), "qr:sms")
        .when(_starts(low, ["http://", "https://", "ftp://"]), "qr:url")
        .otherwise("qr:text")
    )


def mask_payload(tag: Column, raw: Column) -> Column:
    """Handles, addresses and passwords masked; other payloads stay."""
    low = F.lower(raw)
    at = F.locate("pa=", low)
    rest = F.substring(raw, at + 3, F.length(raw))
    vpa = F.substring_index(rest, "&", 1)
    handle = F.substring_index(vpa, "@", 1)
    short = F.when(F.length(handle) > 3, F.concat(F.substring(handle, 1, 2), F.lit("***"), F.right(handle, F.lit(1)))).otherwise("***")
    upi = F.when((at > 0) & vpa.contains("@"), F.concat(F.substring(raw, F.lit(1), at + 2), short, F.substring(vpa, F.length(handle) + 1, F.length(vpa)), F.substring(rest, F.length(vpa) + 1, F.length(rest)))).otherwise("upi://pay?pa=***")
    prefix = F.concat(F.substring_index(raw, ":", 1), F.lit(":"))
    after = F.substring(raw, F.length(prefix) + 1, F.length(raw))
    address = F.substring_index(after, "?", 1)
    crypto = F.concat(prefix, F.substring(address, 1, 4), F.lit("..."), F.right(address, F.lit(4)), F.substring(after, F.length(address) + 1, F.length(after)))
    payment = (
        F.when(low.startswith("upi://"), upi)
        .when(raw.contains(":") & (F.length(address) > 8), crypto)
        .when(raw.startswith("000201") & (F.length(raw) > 12), F.concat(F.substring(raw, 1, 12), F.lit("...[EMVCo Payment QR]")))
        .otherwise("*** [Payment QR Details Protected]")
    )
    # the first `;P:` decides; without one the first `P:`; no `;` after it: unchanged
    wifi = F.when(raw.contains(";P:"), F.regexp_replace(raw, r"(?s)^(.*?);P:[^;]*;", "$1;P:***;")).otherwise(F.regexp_replace(raw, r"(?s)^(.*?)P:[^;]*;", "$1P:***;"))
    return F.when(tag == "qr:payment", payment).when(tag == "qr:wifi", wifi).otherwise(raw)


def is_screenshot(path: Column, width: Column, height: Column, camera_make: Column, camera_model: Column) -> Column:
    """A camera rules it out; else a word in the path, a display's resolution, or a PNG/WebP of at least 1280x720 with a display's aspect."""
    p = F.lower(path)
    word = F.lit(False)
    for w in SCREENSHOT_WORDS:
        word = word | p.contains(w)
    exact = F.lit(False)
    for w, h in RESOLUTIONS:
        exact = exact | ((F.greatest(width, height) == max(w, h)) & (F.least(width, height) == min(w, h)))
    r = F.try_divide(F.greatest(width, height).cast("double"), F.least(width, height))
    aspect = (F.abs(r - 1.777) < 0.02) | (F.abs(r - 1.6) < 0.02) | (F.abs(r - 1.5) < 0.02) | (F.abs(r - 2.333) < 0.05)
    drawn = p.rlike(r"\.(png|webp)$") & aspect & (width >= 1280) & (height >= 720) & (F.least(width, height) > 0)
    return camera_make.isNull() & camera_model.isNull() & (word | F.coalesce(exact, F.lit(False)) | F.coalesce(drawn, F.lit(False)))

"""XMP packets: their fields, and new packets with some fields changed.

A field is named XMP-group:Name, and its value is a list of texts; a structure is a text of JSON.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

# The groups' namespaces, with the prefix that each has in packets.
RDF, META, XML = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "adobe:ns:meta/", "http://www.w3.org/XML/1998/namespace"
GROUPS = {
    "dc": ("dc", "http://purl.org/dc/elements/1.1/"),
    "xmp": ("xmp", "http://ns.adobe.com/xap/1.0/"),
    "tiff": ("tiff", "http://ns.adobe.com/tiff/1.0/"),
    "exif": ("exif", "http://ns.adobe.com/exif/1.0/"),
    "photoshop": ("photoshop", "http://ns.adobe.com/photoshop/1.0/"),
    "lr": ("lr", "http://ns.adobe.com/lightroom/1.0/"),
    "digiKam": ("digiKam", "http://www.digikam.org/ns/1.0/"),
    "iptcCore": ("Iptc4xmpCore", "http://iptc.org/std/Iptc4xmpCore/1.0/xmlns/"),
    "iptcExt": ("Iptc4xmpExt", "http://iptc.org/std/Iptc4xmpExt/2008-02-29/"),
    "album": ("album", "urn:albumspark:xmp:1.0:"),
}
BEGIN, END = '<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?>', '<?xpacket end="w"?>'
#: Groups whose properties begin with a small letter, and fields that are lists however few values they have.
SMALL = ("dc", "lr")
ORDERED = ("XMP-digiKam:TagsList",)
LISTS = (*ORDERED, "XMP-dc:Subject", "XMP-lr:HierarchicalSubject", "XMP-iptcExt:PersonInImage", "XMP-iptcExt:ImageRegion", "XMP-album:OCRText")
#: Characters that XML 1.0 cannot hold.
ODD = re.compile("[^\t\n\r -퟿-�\U00010000-\U0010ffff]")

_GROUP_OF = {uri: group for group, (_, uri) in GROUPS.items()}
for _prefix, _uri in [*GROUPS.values(), ("rdf", RDF), ("x", META)]:
    ET.register_namespace(_prefix, _uri)


def _name(tag: str) -> str | None:
    """XMP-group:Name of a property, if its namespace is known."""
    uri, _, name = tag[1:].partition("}")
    group = _GROUP_OF.get(uri)
    return group and f"XMP-{group}:{name[:1].upper()}{name[1:]}"


def _tag(field: str) -> str:
    group, _, name = field.removeprefix("XMP-").partition(":")
    return f"{{{GROUPS[group][1]}}}{name[:1].lower() + name[1:] if group in SMALL else name}"


def _value(e: ET.Element):
    """A text, a list or a structure."""
    for kind in ("Bag", "Seq", "Alt"):
        held = e.find(f"{{{RDF}}}{kind}")
        if held is not None:
            return [_value(x) for x in held.findall(f"{{{RDF}}}li")]
    inner = e.find(f"{{{RDF}}}Description")
    parts = inner if inner is not None else e
    members = {a.partition("}")[2]: v for a, v in parts.attrib.items() if a.startswith("{") and RDF not in a and XML not in a}
    members |= {x.tag.partition("}")[2]: _value(x) for x in parts}
    return members if members else (e.text or "") if not len(e) else ""


def _texts(value) -> list[str]:
    each = value if isinstance(value, list) else [value]
    return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in each]


def _root(packet: bytes) -> ET.Element:
    """The rdf:RDF element; ValueError where there is none."""
    text = packet.decode("utf-8", "replace").strip("﻿\0 \t\r\n")
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ValueError(f"no XML: {e}") from e
    rdf = root if root.tag == f"{{{RDF}}}RDF" else root.find(f".//{{{RDF}}}RDF")
    if rdf is None:
        raise ValueError("no RDF in the packet")
    return rdf


def _held(rdf: ET.Element) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for about in rdf.findall(f"{{{RDF}}}Description"):
        for a, v in about.attrib.items():
            if name := _name(a):
                out.setdefault(name, []).append(v)
        for e in about:
            if name := _name(e.tag):
                out.setdefault(name, []).extend(_texts(_value(e)))
    return out


def fields(packet: bytes) -> dict[str, list[str]]:
    """All fields of known groups; ValueError for what is no packet."""
    return _held(_root(packet))


def _put(parent: ET.Element, value, uri: str) -> None:
    if isinstance(value, dict):
        parent.set(f"{{{RDF}}}parseType", "Resource")
        for k, v in value.items():
            _put(ET.SubElement(parent, f"{{{uri}}}{k}"), v, uri)
    elif isinstance(value, list):
        bag = ET.SubElement(parent, f"{{{RDF}}}Bag")
        for v in value:
            _put(ET.SubElement(bag, f"{{{RDF}}}li"), v, uri)
    else:
        parent.text = ODD.sub("", value if isinstance(value, str) else json.dumps(value))


def _structured(text: str):
    try:
        found = json.loads(text)
    except ValueError:
        return text
    return found if isinstance(found, dict) else text


def changed(packet: bytes | None, new: dict[str, list[str]] | Callable[[dict[str, list[str]]], dict[str, list[str]]]) -> bytes:
    """The packet with these fields in place of its own; an empty list removes a field. All else stays. Characters that XML
    cannot hold are left out, fields of unknown groups too. None: a new packet. new may be a function of the packet's fields."""
    rdf = ET.Element(f"{{{RDF}}}RDF") if packet is None else _root(packet)
    if callable(new):
        new = new(_held(rdf))
    if rdf.find(f"{{{RDF}}}Description") is None:
        ET.SubElement(rdf, f"{{{RDF}}}Description", {f"{{{RDF}}}about": ""})
    abouts = rdf.findall(f"{{{RDF}}}Description")
    for field, values in new.items():
        group = field.removeprefix("XMP-").partition(":")[0]
        if not field.startswith("XMP-") or group not in GROUPS:
            continue
        tag = _tag(field)
        for about in abouts:
            about.attrib.pop(tag, None)
            for e in about.findall(tag):
                about.remove(e)
        if not values:
            continue
        e, uri = ET.SubElement(abouts[0], tag), GROUPS[group][1]
        own = [_structured(v) if v.startswith("{") else v for v in values]
        if field in LISTS or len(own) > 1:
            bag = ET.SubElement(e, f"{{{RDF}}}{'Seq' if field in ORDERED else 'Bag'}")
            for v in own:
                _put(ET.SubElement(bag, f"{{{RDF}}}li"), v, uri)
        else:
            _put(e, own[0], uri)
    meta = ET.Element(f"{{{META}}}xmpmeta")
    meta.append(rdf)
    return f"{BEGIN}\n{ET.tostring(meta, encoding='unicode')}\n{END}".encode()

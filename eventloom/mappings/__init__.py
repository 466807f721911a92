"""Target schemas as data, and the model that applies them."""

from eventloom.mappings import http, network, process
from eventloom.mappings.model import Mapping, Record, apply_mapping
from eventloom.mappings.shared import DEFAULT_IDENTITY, CefMapping, Identity

_FAMILIES = {"http": http, "network": network, "process": process}


def mapping_for(
    family: str, format: str, identity: Identity = DEFAULT_IDENTITY
) -> Mapping | CefMapping:
    """The mapping of a log family (http, network, process) into a format."""
    module = _FAMILIES[family]
    if format in ("cef", "udm"):
        return getattr(module, format)(identity)
    return getattr(module, format.upper())


__all__ = [
    "CefMapping",
    "DEFAULT_IDENTITY",
    "Identity",
    "Mapping",
    "Record",
    "apply_mapping",
    "mapping_for",
]

"""What several mappings have in common."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.constants import PRODUCT, PRODUCT_VERSION, VENDOR
from eventloom.functions.cef import cef_line
from eventloom.mappings.model import Mapping, Record, bind_rule, computed, constant


@dataclass(frozen=True)
class Identity:
    """The device named in CEF headers and UDM metadata."""

    vendor: str = VENDOR
    product: str = PRODUCT
    version: str = PRODUCT_VERSION


DEFAULT_IDENTITY = Identity()


@dataclass(frozen=True)
class CefMapping:
    """A CEF line: class id, name and severity, and the extensions as a mapping."""

    identity: Identity
    class_id: Callable[[Record], Column]
    name: Callable[[Record], Column]
    extensions: Mapping
    severity: str = "3"
    escape_newlines: bool = False

    @property
    def prepare(self) -> Callable[[DataFrame], DataFrame]:
        return self.extensions.prepare

    def document(self, record: Record) -> Column:
        header = [
            F.lit(self.identity.vendor),
            F.lit(self.identity.product),
            F.lit(self.identity.version),
            self.class_id(record),
            self.name(record),
            F.lit(self.severity),
        ]
        values = self.extensions.values(record)
        pairs = [(path[-1], value.text()) for path, value in values]
        numbers = {path[-1] for path, value in values if value.digits}
        return cef_line(header, pairs, self.escape_newlines, numbers)

    # A CEF event is its line, whichever form is asked for.
    event = document

    def flat(self, record: Record) -> list[Column]:
        return [
            self.document(record).alias("cef"),
            *(
                bind_rule(rule, record).text().cast("string").alias(path[-1])
                for path, rule in self.extensions.fields
            ),
        ]


def udm_metadata(timestamp, event_type: str, identity: Identity) -> list:
    return [
        (("metadata", "event_timestamp"), timestamp),
        (("metadata", "event_type"), constant(event_type)),
        (("metadata", "vendor_name"), constant(identity.vendor)),
        (("metadata", "product_name"), constant(identity.product)),
        (("metadata", "product_version"), constant(identity.version)),
    ]


def one_element(name: str, default: str):
    """A source column as an array of one."""
    return computed(lambda rec: F.array(rec.default(name, F.lit(default))))

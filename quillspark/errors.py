"""Typed refusals: a request that cannot be answered whole raises instead of returning less."""

from __future__ import annotations


class Refusal(Exception):
    """Base of all refusals."""


class MissingColumn(Refusal, KeyError):
    """A requested column is absent from a generation."""


class DatasetUnknown(Refusal, LookupError):
    """A name does not resolve to a dataset."""


class NothingPublished(Refusal, LookupError):
    """Filters match no file or partition."""


class FilterHasNoAxis(Refusal, ValueError):
    """A filter on an axis that the files are not split on."""


class PartialFetch(Refusal, RuntimeError):
    """Some of the selected sources gave nothing."""


class RequestTooLarge(Refusal, ValueError):
    """Selected bytes are over the limit."""


class LabelUnavailable(Refusal, LookupError):
    """A strict label request cannot be met."""


class UnsupportedStratification(Refusal, ValueError):
    """A breakdown that a series does not carry."""


class TranslationImpossible(Refusal, ValueError):
    """A caller's table cannot be labelled."""


class MassDisappearance(Refusal, RuntimeError):
    """A snapshot withdraws too much to be believed."""


class CatalogShape(Refusal, RuntimeError):
    """A catalog's tables differ from what is expected."""


class CurationInvalid(Refusal, ValueError):
    """An authored file breaks its rules."""


class BundleInvalid(Refusal, ValueError):
    """A bundle is unreadable or incompatible."""


class DecodeFailed(Refusal, ValueError):
    """A payload is not a table."""


class UnsupportedContainer(Refusal, NotImplementedError):
    """No reader for this container is installed."""


class ArchiveQuota(Refusal, ValueError):
    """An archive is over its limits."""


class HeaderUnreadable(Refusal, ValueError):
    """A byte prefix is not a header."""


class ItemTimeout(Refusal, TimeoutError):
    """An item's deadline passed."""


class SchemaConflict(Refusal, TypeError):
    """Generations give one column types that cannot be reconciled."""

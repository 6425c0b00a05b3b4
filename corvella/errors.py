"""Errors the engine raises."""


class StoreError(Exception):
    """Any failure of the engine."""


class EmptyStoreError(StoreError):
    """Search in a store without documents."""


class UnknownNamespaceError(StoreError):
    def __init__(self, name: str, known: list[str]):
        super().__init__(f"no namespace {name!r}; there are {', '.join(known) or 'none'}")


class DeniedError(StoreError):
    def __init__(self, permission: str, role: str):
        super().__init__(f"role {role} lacks the permission {permission}")


class AlphaError(StoreError):
    def __init__(self, alpha: float):
        super().__init__(f"alpha must be within 0 and 1, not {alpha}")


class KeyFormError(StoreError, ValueError):
    """An encryption key that is too short or cannot open the store."""


class ConflictError(StoreError):
    """Another writer made the version first; the change may be tried again."""

    def __init__(self, version: int):
        super().__init__(f"version {version} was written by another")


class DimensionError(StoreError, ValueError):
    def __init__(self, got: int, wanted: int):
        super().__init__(f"vectors of length {got}, not {wanted}")


class ProtectedError(StoreError):
    """Deletion while the store is protected."""


class FileIngestError(StoreError):
    def __init__(self, path: str, why: str):
        super().__init__(f"{path}: {why}")

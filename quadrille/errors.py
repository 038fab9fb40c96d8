class QueryError(ValueError):
    """A plan, a snapshot or a write that the engine refuses; code says why."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code

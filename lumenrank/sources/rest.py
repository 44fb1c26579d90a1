"""A JSON source over HTTP for offline jobs: one object for each key, errors as nothing."""

import json
import urllib.parse
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor


class JsonSource:
    """Objects at ``base`` + path, with a bearer token or else an API key as a parameter.

    ``opener`` takes a request and a timeout and returns a readable answer; tests hand in their own.
    """

    def __init__(self, base: str, key: str = "", token: str = "", timeout: float = 5.0, workers: int = 8, opener: Callable = urllib.request.urlopen):
        self.base, self.key, self.token, self.timeout, self.workers, self.opener = base, key, token, timeout, max(1, workers), opener

    def get(self, path: str, **params) -> dict | None:
        """The object at a path; None without a credential, after an error, or where the answer is no object."""
        if not (self.key or self.token):
            return None
        query = dict(params) if self.token else {"api_key": self.key, **params}
        url = f"{self.base}{path}" + ("?" + urllib.parse.urlencode(query) if query else "")
        request = urllib.request.Request(url, headers={"Authorization": f"Bearer {self.token}"} if self.token else {})
        try:
            with self.opener(request, timeout=self.timeout) as answer:
                found = json.loads(answer.read())
        except Exception:  # unreachable, refused, late or no JSON: this key has nothing
            return None
        return found if isinstance(found, dict) else None

    def fetch(self, path_of: Callable[[object], str], keys: list, **params) -> dict:
        """Objects by key, ``workers`` at a time; keys without one lack."""
        unique = list(dict.fromkeys(keys))
        with ThreadPoolExecutor(self.workers) as pool:
            found = pool.map(lambda k: self.get(path_of(k), **params), unique)
            return {k: v for k, v in zip(unique, found) if v is not None}

"""The only Python functions of the library: BLAKE2s, which has no built-in.

They are made inside functions so that they travel to the executors by value and
need no installed package there.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def seed_integer(fingerprint: Column, salt: str = "") -> Column:
    """32-bit integer seed from a fingerprint and a salt."""
    import pandas as pd

    def digests(texts: pd.Series) -> pd.Series:
        import hashlib

        return texts.map(lambda t: hashlib.blake2s(t.encode(), digest_size=4).hexdigest(), na_action="ignore")

    digest = F.pandas_udf(digests, "string")
    return F.conv(digest(F.concat(fingerprint, F.lit(salt))), 16, 10).cast("bigint")


def sorted_digests() -> Callable:
    """Digest of each run of equal ``lattice_id`` in sorted input, row texts joined by a space.

    Only the hash state of the current lattice is held, not its rows.
    """

    def digests(batches):
        import hashlib

        import pandas as pd

        current, state = object(), None
        for batch in batches:
            done = []
            for key, text in zip(batch["lattice_id"], batch["text"]):
                if state is None or key != current:
                    if state is not None:
                        done.append((current, state.hexdigest()))
                    current, state = key, hashlib.blake2s(digest_size=8)
                else:
                    state.update(b" ")
                state.update(text.encode())
            if done:
                yield pd.DataFrame(done, columns=["lattice_id", "fingerprint"])
        if state is not None:
            yield pd.DataFrame([(current, state.hexdigest())], columns=["lattice_id", "fingerprint"])

    return digests

"""License scans by diagonal voting.

1. Every rolling word k-gram of every document, for both values of k, becomes a row (document, position, two 64-bit hashes); Spark
   joins them to the template positions that have the same hash, and compares the second hash. Templates of WHOLE_WORDS words or
   more have k-grams of TEXT_K words, which few other texts share, shorter ones those of PHRASE_K words.
2. A hit votes for its diagonal, document position minus template position; votes are summed up by document,
   template and diagonal, so a copied passage is one strong diagonal.
3. Neighbouring diagonals that overlap or nearly so are merged, so that a few inserted or missing words do not break
   a passage.
4. A span is verified by the share of the template's words that its confirmed k-grams cover: all of them for a phrase,
   SHARE for a text of WHOLE_WORDS words or more.

Words are runs of ASCII letters, digits and everything beyond ASCII, in lower case.

Defined results: a null or empty text has no words and no labels; ties among spans are ordered by first word, then
template; a document id that stands in several rows gets the result of each row's own text; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text
from ._held import tidy
from ._session import small_batches

PHRASE_K, TEXT_K = 2, 4
SHARE, WHOLE_WORDS = 0.6, 9
#: Diagonals of one passage lie so close together (an address more or less in a long text moves them by its words), and its hits within
#: so many words of each other.
PHRASE_DRIFT, TEXT_DRIFT, BREAK = 4, 8, 12
#: Rows of the template side that may be broadcast.
MOST_POSITIONS = 100_000

#: The phrases of the contract and their labels.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Well-known openings of public license texts and notices, with the label each one shows.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "BSD License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("mpl", "Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc", "licensed under a Creative Commons Attribution"),
    ("cc", "licensed under CC BY"),
)
#: The wording of short public licenses as a whole, without title and copyright line.
TEXTS = (
    ("mit",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
     "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
     "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
     "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
     "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
     "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
     "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
     "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
     "PERFORMANCE OF THIS SOFTWARE."),
    ("bsd",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
     "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
     "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
     "disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor "
     "the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
     "permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
     "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
     "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
     "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
     "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
     "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("apache",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You "
     "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
     "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
     "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
     "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed "
     "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
     "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
     "License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("zlib",
     "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
     "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
     "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must "
     "not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
     "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly "
     "marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
     "source distribution."),
    ("mpl",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
     "file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)


def _k(n_words: int) -> int:
    return TEXT_K if n_words >= WHOLE_WORDS else PHRASE_K


def _hashes(texts: pa.Array):
    """For each chunk of texts: the chunk, its words, and for each k the hashes and second hashes of its k-grams."""
    for c in _text.chunks(texts):
        data = _text.lower(c.data)
        w = _text.words(data, c.bounds, _text.ALNUM)
        h = _text.word_hashes(data, w)
        second = _text.mix(h + np.uint64(0x632BE59BD9B4E019))
        yield c, w, {k: (_text.gram_hashes(h, k), _text.gram_hashes(second, k)) for k in (PHRASE_K, TEXT_K)}


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES + TEXTS) -> DataFrame:
    """One row for each k-gram of each template: template, label, base, k, n_words, t_at, gram, check. Phrases are base."""
    rows, texts = [], [*((label, t, True) for label, t in phrases), *((label, t, False) for label, t in notices)]
    for c, w, hashes in _hashes(pa.array([t[1] for t in texts])):
        for r in range(c.rows):
            a, z = int(w.rows[r]), int(w.rows[r + 1])
            label, _, base = texts[c.first + r]
            k = _k(z - a)
            if z - a < k:
                raise ValueError("a template needs at least two words")
            gram, check = hashes[k]
            rows += [(c.first + r, label, base, k, z - a, i - a, int(gram[i].astype(np.int64)), int(check[i].astype(np.int64))) for i in range(a, z - k + 1)]
    if len(rows) > MOST_POSITIONS:
        raise ValueError(f"{len(rows)} template positions; at most {MOST_POSITIONS} are broadcast")
    return spark.createDataFrame(rows, "template int, label string, base boolean, k int, n_words int, t_at int, gram bigint, check bigint")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The key tells rows of one id apart that have different texts."""
    return df.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))


def grams(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each k-gram of each document and each k: doc, text_key, at, gram, check."""

    @tidy
    def run(batches):
        for b in batches:
            keys = np.asarray(b.column(1))
            for c, w, hashes in _hashes(b.column(2)):
                row = _text.row_of(w)
                at = np.arange(len(row)) - w.rows[row]
                for k, (gram, check) in hashes.items():
                    ok = _text.within_rows(w, k)
                    mine = c.first + row[ok]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(mine)), pa.array(keys[mine]), pa.array(at[ok]), pa.array(gram[ok].view(np.int64)), pa.array(check[ok].view(np.int64))],
                        ["doc", "text_key", "at", "gram", "check"],
                    )

    kind = df.schema[id_col].dataType.simpleString()
    return _keyed(df, id_col, text_col).mapInArrow(run, f"doc {kind}, text_key bigint, at bigint, gram bigint, check bigint")


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc, text_key, n_words."""

    @tidy
    def run(batches):
        for b in batches:
            out = [np.diff(_text.words(c.data, c.bounds, _text.ALNUM).rows) for c in _text.chunks(b.column(2))]
            counts = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), counts], ["doc", "text_key", "n_words"])

    kind = df.schema[id_col].dataType.simpleString()
    return _keyed(df, id_col, text_col).mapInArrow(run, f"doc {kind}, text_key bigint, n_words bigint")


def spans(gram_rows: DataFrame, held: DataFrame) -> DataFrame:
    """Verified spans: doc, text_key, template, label, base, first_word, last_word, share."""
    hits = gram_rows.join(F.broadcast(held), ["gram", "check"])
    key = ["doc", "text_key", "template", "label", "base", "k", "n_words"]
    votes = hits.groupBy(*key, (F.col("at") - F.col("t_at")).alias("diagonal")).agg(
        F.min("at").alias("lo"), F.max("at").alias("hi"), F.collect_set("t_at").alias("t_ats")
    )
    # Neighbours on the diagonal axis that also lie near each other in the document are one passage; a diagonal between them
    # with a hit elsewhere in the passage does not part them, so the furthest hit so far counts.
    by = Window.partitionBy("doc", "text_key", "template").orderBy("diagonal")
    drift = F.when(F.col("k") == TEXT_K, TEXT_DRIFT).otherwise(PHRASE_DRIFT)
    apart = (F.col("diagonal") - F.lag("diagonal").over(by) > drift) | (F.col("lo") - F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1)) > BREAK) | F.col("base")
    marked = votes.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(1))).withColumn("passage", F.sum("apart").over(by))
    merged = marked.groupBy(*key, "passage").agg(
        F.min("lo").alias("first_word"), (F.max("hi") + F.col("k") - 1).alias("last_word"), F.array_distinct(F.flatten(F.collect_list("t_ats"))).alias("t_ats")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("t_ats", lambda t: F.sequence(t, t + F.col("k") - 1)))))
    share = (covered / F.col("n_words")).cast("double")
    whole = F.size("t_ats") == F.col("n_words") - F.col("k") + 1
    return merged.withColumn("share", share).where(F.when(F.col("base") | (F.col("n_words") < WHOLE_WORDS), whole).otherwise(F.col("share") >= SHARE)).drop("t_ats", "passage", "n_words", "k")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES + TEXTS) -> DataFrame:
    """Per row: id, n_words, and its spans in order of their first word (array of structs)."""
    small_batches(df.sparkSession)
    found = spans(grams(df, id_col, text_col), templates(df.sparkSession, phrases, notices))
    one = F.struct("first_word", "last_word", "template", "label", "base", "share")
    # A document's spans are bounded by its own length.
    per_doc = found.groupBy("doc", "text_key").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    docs = word_counts(df, id_col, text_col)
    # Keys may be null, so the join is null-safe on the id; the text key never is null.
    joined = docs.alias("d").join(per_doc.alias("s"), F.expr("d.doc <=> s.doc AND d.text_key = s.text_key"), "left")
    return joined.select(F.col("d.doc").alias(id_col), F.col("d.n_words"), F.coalesce(F.col("s.spans"), F.array()).alias("spans"))

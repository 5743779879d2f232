"""Sums of resamples in the order of Python's generator, drawn by many tasks.

The generator (MT19937) is one sequence of 32-bit words, but a linear one: the state
any number of words ahead is a polynomial of the step, applied to the state. So the
words are dealt to lots, and each lot begins from its own state. ``randrange`` passes
over words out of range, so where a replicate ends is known only once the words
before are counted: a lot notes of each page of words how many draws it holds, their
sum, and the state it begins with; the pages in which replicates end are then drawn
once more, up to there.

The draws themselves are two Java functions: numpy takes several times as long for
them, as each of its steps goes through memory and a worker has its own table. The
session's JVM compiles them with Janino, which Spark has for its own plans.
"""

from __future__ import annotations

import json
import os
import random
import tempfile
import uuid
import zipfile
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.sources.storage import written

# Fixed values of MT19937: words of a state, the middle word, bits of a state, the twist.
WORDS, MIDDLE, DEGREE, TWIST = 624, 397, 19937, 0x9908B0DF
LEAST = 8192  # states of a lot, and 52 of a page

_JAVA = """
package siltstone;

import java.nio.ByteBuffer;
import java.nio.ByteOrder;
import java.util.Arrays;
import org.apache.spark.sql.RowFactory;
import org.apache.spark.sql.api.java.UDF4;
import org.apache.spark.sql.api.java.UDF5;

/** Draws from a state on: codes of the values drawn (value + 2), 0 of words passed over. */
class Draws {
  int[] x = new int[624], y = new int[624];
  final int[] at = new int[624];
  final byte[] table;
  final int shift, end;
  static byte[] last;
  long drawn, total;

  Draws(byte[] key, byte[] table, long n) {
    ByteBuffer.wrap(key).order(ByteOrder.LITTLE_ENDIAN).asIntBuffer().get(x);
    this.table = shared(table);
    shift = Long.numberOfLeadingZeros(n) - 32;
    end = (int) n ^ 0x80000000;  // orders unsigned numbers
  }

  /** One table for all tasks of an executor: cores that share a cache look up one copy. */
  static synchronized byte[] shared(byte[] table) {
    if (!Arrays.equals(last, table)) last = table;
    return last;
  }

  byte[] key() {
    ByteBuffer out = ByteBuffer.allocate(4 * 624).order(ByteOrder.LITTLE_ENDIAN);
    out.asIntBuffer().put(x);
    return out.array();
  }

  static void twist(int[] x, int[] y) {
    for (int k = 0; k < 227; k++) { int v = (x[k] & 0x80000000) | (x[k + 1] & 0x7fffffff); y[k] = x[k + 397] ^ (v >>> 1) ^ (-(v & 1) & 0x9908b0df); }
    for (int k = 227; k < 454; k++) { int v = (x[k] & 0x80000000) | (x[k + 1] & 0x7fffffff); y[k] = y[k - 227] ^ (v >>> 1) ^ (-(v & 1) & 0x9908b0df); }
    for (int k = 454; k < 623; k++) { int v = (x[k] & 0x80000000) | (x[k + 1] & 0x7fffffff); y[k] = y[k - 227] ^ (v >>> 1) ^ (-(v & 1) & 0x9908b0df); }
    int v = (x[623] & 0x80000000) | (y[0] & 0x7fffffff);
    y[623] = y[396] ^ (v >>> 1) ^ (-(v & 1) & 0x9908b0df);
  }

  static void temper(int[] x, int[] at, int shift, int end) {
    for (int k = 0; k < 624; k++) {
      int v = x[k];
      v ^= v >>> 11;
      v ^= (v << 7) & 0x9d2c5680;
      v ^= (v << 15) & 0xefc60000;
      v ^= v >>> 18;
      at[k] = Math.min((v >>> shift) ^ 0x80000000, end) ^ 0x80000000;
    }
  }

  static long count(int[] at, byte[] table, int n) {
    int drawn = 0, codes = 0;
    for (int k = 0; k < 624; k++) { int i = at[k]; codes += table[i >>> 2] >> ((i & 3) << 1) & 3; }
    for (int k = 0; k < 624; k++) { int v = at[k] ^ n; drawn += (v | -v) >>> 31; }  // n stands for words passed over
    return (long) drawn << 32 | codes;
  }

  /** The next 624 words. */
  void next() {
    twist(x, y);
    int[] z = x;
    x = y;
    y = z;
    temper(x, at, shift, end);
  }

  void add() {
    long both = count(at, table, end ^ 0x80000000);
    drawn += both >>> 32;
    total += (both & 0xffffffffL) - 2 * (both >>> 32);
  }

  int code(int k) {
    return table[at[k] >>> 2] >> ((at[k] & 3) << 1) & 3;
  }
}

/** Of pages of so many states: draws, their sum, and the state before them. */
public class Pages implements UDF5 {
  public Object call(Object key, Object table, Object n, Object states, Object pages) {
    Draws d = new Draws((byte[]) key, (byte[]) table, ((Long) n).longValue());
    Object[] rows = new Object[((Long) pages).intValue()];
    for (int p = 0; p < rows.length; p++) {
      byte[] start = d.key();
      d.drawn = d.total = 0;
      for (long s = ((Long) states).longValue(); s > 0; s--) { d.next(); d.add(); }
      rows[p] = RowFactory.create(new Object[] {Long.valueOf(d.drawn), Long.valueOf(d.total), start});
    }
    return rows;
  }
}

/** The sums up to numbers of draws (64-bit words, ascending). */
public class Ends implements UDF4 {
  public Object call(Object key, Object table, Object n, Object ends) {
    Draws d = new Draws((byte[]) key, (byte[]) table, ((Long) n).longValue());
    ByteBuffer wanted = ByteBuffer.wrap((byte[]) ends).order(ByteOrder.LITTLE_ENDIAN);
    Object[] sums = new Object[wanted.remaining() / 8];
    for (int e = 0; e < sums.length;) {
      d.next();
      long drawn = d.drawn, total = d.total;
      d.add();
      for (int k = 0; k < 624 && e < sums.length && wanted.getLong(8 * e) <= d.drawn; k++) {
        int code = d.code(k);
        if (code == 0) continue;
        drawn++;
        total += code - 2;
        if (drawn == wanted.getLong(8 * e)) sums[e++] = Long.valueOf(total);
      }
    }
    return sums;
  }
}
"""


def _functions(spark: SparkSession):
    """``pages`` and ``ends`` of the Java text, for expressions; compiled once a session's JVM."""
    jvm, session = spark.sparkContext._jvm, spark._jsparkSession
    names = {"Pages": T.ArrayType(T.StructType([T.StructField("drawn", T.LongType()), T.StructField("total", T.LongType()), T.StructField("state", T.BinaryType())])), "Ends": T.ArrayType(T.LongType())}
    if not spark.catalog.functionExists("siltstone_ends"):
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(_JAVA)
        path = os.path.join(tempfile.mkdtemp(prefix="siltstone-"), f"siltstone-{uuid.uuid4().hex}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for name, code in compiler.getBytecodes().items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
        spark.sparkContext._jsc.addJar(path)
        for name, returned in names.items():
            made = compiler.getClassLoader().loadClass(f"siltstone.{name}").newInstance()
            session.udf().register(f"siltstone_{name.lower()}", made, session.parseDataType(json.dumps(returned.jsonValue())))
    return (lambda *c: F.call_function("siltstone_pages", *c)), (lambda *c: F.call_function("siltstone_ends", *c))


def _characteristic() -> int:
    """The generator's characteristic polynomial over GF(2), as bits (Matsumoto and
    Nishimura 1998): u v^31 + a0 u v^30 + ... + a30 u + a31, a being the twist's bits."""
    p = u = 1 << WORDS | 1 << MIDDLE
    for k in range(31):
        p = p << WORDS - 1 ^ p << MIDDLE - 1 ^ (u if TWIST >> k & 1 else 0)
    return p ^ TWIST >> 31


def _places(p: int) -> list[int]:
    return np.flatnonzero(np.unpackbits(np.frombuffer(p.to_bytes(DEGREE // 8 + 1, "little"), np.uint8), bitorder="little")).tolist()


_TERMS = _places(_characteristic() ^ 1 << DEGREE)


def _squared(p: int, times: int = 0) -> int:
    """p^2 t^times modulo the characteristic polynomial."""
    p = int(format(p, "b"), 4) << times  # base 4 puts a 0 between all bits: a square over GF(2)
    while high := p >> DEGREE:
        p = reduce(lambda q, k: q ^ high << k, _TERMS, p ^ high << DEGREE)
    return p


def steps(words: int) -> int:
    """The polynomial that takes a state ``words`` words ahead."""
    return reduce(lambda p, bit: _squared(p, int(bit)), format(words, "b"), 1)


def ahead(key: np.ndarray, p: int) -> np.ndarray:
    """The state of which ``p`` says how far it is ahead of ``key``."""
    x = np.empty(WORDS + DEGREE, np.uint32)
    x[:WORDS] = key
    for k in range(WORDS, len(x), WORDS - MIDDLE):
        m = min(WORDS - MIDDLE, len(x) - k)
        y = (x[k - WORDS:k - WORDS + m] & 0x80000000) | (x[k - WORDS + 1:k - WORDS + 1 + m] & 0x7FFFFFFF)
        x[k:k + m] = x[k - WORDS + MIDDLE:k - WORDS + MIDDLE + m] ^ (y >> 1) ^ (y & 1) * np.uint32(TWIST)
    out = np.zeros(WORDS, np.uint32)
    for k in _places(p):
        out ^= x[k:k + WORDS]
    return out


def _packed(values: np.ndarray) -> np.ndarray:
    """Four values a byte, value + 2 in two bits, and 0 at the place after the last:
    a table of random look-ups has to stay in a core's cache."""
    codes = np.zeros((len(values) // 4 + 1, 4), np.uint8)
    codes.reshape(-1)[:len(values)] = values + 2
    return codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6


def drawn_sums(spark: SparkSession, values: np.ndarray, seed: int, replicates: int, slack: float = 6.0) -> list[int]:
    """The sum of each of ``replicates`` resamples of ``values`` (-1, 0 and 1): what
    ``random.Random(seed).randrange`` draws, in its order. ``slack``: standard
    deviations of words beyond the mean that are drawn at once; where these are too
    few, more follow."""
    n = len(values)
    pages_of, ends_of = _functions(spark)
    wanted, share = n * replicates, n / (1 << n.bit_length())
    states = max(52, (1 << n.bit_length()) // 8 // WORDS)
    lots_most = 8 * spark.sparkContext.defaultParallelism
    table = F.broadcast(spark.createDataFrame(pa.table({"table": [_packed(values).tobytes()]})))  # one row
    key = np.array(random.Random(seed).getstate()[1][:-1], np.uint32)  # all of its words used up
    parts, counts, got = [], [], 0
    while got < wanted:
        rest, first = wanted - got, sum(len(c) for c in counts)
        pages = max(0, int((rest + slack * (rest * (1 - share)) ** 0.5) / share)) // (states * WORDS) + 1
        each = -(-pages // max(1, min(lots_most, pages * states // LEAST)))
        lots, move, keys = -(-pages // each), steps(each * states * WORDS), [key]
        while len(keys) <= lots:
            keys.append(ahead(keys[-1], move))
        dealt = spark.createDataFrame(pa.table({"id": range(lots), "key": [k.tobytes() for k in keys[:lots]]}))
        rows = spark.range(0, lots, 1, lots).join(F.broadcast(dealt), "id").crossJoin(table)  # a lot a task
        rows = rows.select("id", F.posexplode(pages_of("key", "table", F.lit(n).cast("long"), F.lit(states).cast("long"), F.lit(each).cast("long"))).alias("k", "p"))
        parts.append(written(rows.select((F.lit(first) + F.col("id") * each + F.col("k")).alias("page"), "p.drawn", "p.total", "p.state"), "draws"))
        counts.append(np.array(sorted(zip(*(c.to_pylist() for c in parts[-1].select("page", "drawn", "total").toArrow().columns)))))
        got, key = got + int(counts[-1][:, 1].sum()), keys[-1]
    counts = np.concatenate(counts)
    drawn, totals = np.cumsum(counts[:, 1]), np.cumsum(counts[:, 2])
    ends = n * np.arange(1, replicates + 1)
    pages, first, many = np.unique(np.searchsorted(drawn, ends), return_index=True, return_counts=True)
    before = np.concatenate([[0], drawn])[pages], np.concatenate([[0], totals])[pages]
    asked = spark.createDataFrame(pa.table({"page": pages, "replicate": first, "ends": [(ends[f:f + m] - b).astype("<i8").tobytes() for f, m, b in zip(first, many, before[0])]}))
    again = reduce(DataFrame.unionByName, parts).select("page", "state").join(F.broadcast(asked), "page").repartition(lots_most).crossJoin(table)
    found = again.select("replicate", F.posexplode(ends_of("state", "table", F.lit(n).cast("long"), "ends")).alias("k", "total"))
    within = dict(zip(*(c.to_pylist() for c in found.select(F.col("replicate") + F.col("k"), "total").toArrow().columns)))
    return np.diff(np.repeat(before[1], many) + np.array([within[k] for k in range(replicates)]), prepend=0).tolist()

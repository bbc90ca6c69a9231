"""Suffix sorting by linear grouping, as a JVM function that Spark runs on its executors.

Phase 1 sorts the suffixes into groups by their Lyndon prefix: groups are taken in descending order, each
member's previous smaller pointer is followed, and the suffixes pointed at move, by the number of pointers
they got, into a new group behind their old one. Phase 2 goes through the order from its start and puts each
suffix whose next smaller suffix has just been met in the next free place of its group. No step renames
or recurses.

The kernel is a loop over integers which Python would run a hundred times slower, so it is compiled at run
time with the compiler that Spark itself uses for its generated code (its jars hold it) and sent to the executors as a jar.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

CLASS = "linkloom.kernel.LyndonSort"
NAME = "linkloom_lyndon_sort"

SOURCE = """
package linkloom.kernel;

public class LyndonSort implements org.apache.spark.sql.api.java.UDF1, java.io.Serializable {
  /** The suffix array of a byte string, as little-endian 32-bit integers. */
  public Object call(Object text) throws Exception {
    if (text == null) return null;
    int[] order = order((byte[]) text);
    byte[] out = new byte[4 * order.length];
    java.nio.ByteBuffer.wrap(out).order(java.nio.ByteOrder.LITTLE_ENDIAN).asIntBuffer().put(order);
    return out;
  }

  static int[] order(byte[] text) {
    int n = text.length;
    int[] sa = new int[n];     // suffixes, group by group
    int[] at = new int[n];     // place of a suffix in sa
    int[] group = new int[n];  // first place of the group of a suffix
    int[] size = new int[n];   // members of the group that begins at a place
    int[] prev = new int[n];   // previous smaller pointer, by group
    int[] hits = new int[n];
    int[] touched = new int[n];
    int[] chosen = new int[n];
    int[] first = new int[257];
    for (int i = 0; i < n; i++) first[(text[i] & 255) + 1]++;
    for (int c = 0; c < 256; c++) first[c + 1] += first[c];
    for (int i = 0; i < n; i++) {
      int g = first[text[i] & 255];
      int place = g + size[g]++;
      sa[place] = i; at[i] = place; group[i] = g;
    }
    for (int end = n - 1; end >= 0; ) {
      int start = group[sa[end]];
      for (int k = start; k <= end; k++) {
        int p = sa[k] - 1;
        while (p >= 0 && group[p] > start) p = prev[p];
        prev[sa[k]] = p;
      }
      for (int k = start; k <= end; k++) {  // pointers within the group lead on to what lies below it
        int p = prev[sa[k]];
        while (p >= 0 && group[p] == start) p = prev[p];
        for (int q = sa[k]; q != p && q >= 0 && group[q] == start; ) { int next = prev[q]; prev[q] = p; q = next; }
      }
      int left = 0, most = 0;
      for (int k = start; k <= end; k++) {
        int p = prev[sa[k]];
        if (p < 0) continue;
        if (hits[p]++ == 0) touched[left++] = p;
        if (hits[p] > most) most = hits[p];
      }
      for (int level = most; level >= 1 && left > 0; level--) {
        int kept = 0, c = 0;
        for (int x = 0; x < left; x++) {
          int j = touched[x];
          if (hits[j] == level) { chosen[c++] = j; hits[j] = 0; } else touched[kept++] = j;
        }
        left = kept;
        for (int x = 0; x < c; x++) {
          int j = chosen[x];
          int to = group[j] + --size[group[j]], from = at[j], other = sa[to];
          sa[to] = j; at[j] = to; sa[from] = other; at[other] = from;
        }
        for (int x = 0; x < c; x++) group[chosen[x]] += size[group[chosen[x]]];
        for (int x = 0; x < c; x++) size[group[chosen[x]]]++;
      }
      end = start - 1;
    }
    int[] free = at;  // the next free place of the group that begins at a place
    for (int i = 0; i < n; i++) free[group[i]] = group[i];
    boolean[] placed = new boolean[n];
    for (int r = -1; r < n; r++) {  // -1: the empty suffix, smaller than all
      for (int s = (r < 0 ? n : sa[r]) - 1; s >= 0 && !placed[s]; s = prev[s]) {
        sa[free[group[s]]++] = s;
        placed[s] = true;
      }
    }
    return sa;
  }
}
"""


def lyndon_sort(spark: SparkSession, text: Column) -> Column:
    """Column function: suffix array of a binary column. Null in, null out."""
    session = spark._jsparkSession
    if not session.catalog().functionExists(NAME):
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.Thread.currentThread().getContextClassLoader())
        compiler.cook(SOURCE)
        classes = compiler.getBytecodes()
        jar = os.path.join(tempfile.mkdtemp(prefix="linkloom-"), "linkloom-kernel.jar")  # the driver serves it to executors
        with zipfile.ZipFile(jar, "w") as z:
            for name in classes:
                z.writestr(name.replace(".", "/") + ".class", bytes(classes[name]))
        spark.sql(f"ADD JAR '{jar}'")
        made = compiler.getClassLoader().loadClass(CLASS)
        kernel = made.getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0)).newInstance(gateway.new_array(jvm.java.lang.Object, 0))
        session.udf().register(NAME, kernel, session.parseDataType('"binary"'))
    return F.call_function(NAME, text)

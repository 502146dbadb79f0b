from pathlib import Path

from logweave.plans.scratch import written


def test_freed_native_memory_of_the_driver_goes_back(spark):
    jvm = spark.sparkContext._jvm
    held = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    held.setAccessible(True)
    unsafe = held.get(None)
    status = Path("/proc") / jvm.java.io.File("/proc/self").getCanonicalFile().getName() / "status"

    def resident() -> int:
        return next(int(x.split()[1]) for x in status.read_text().splitlines() if x.startswith("VmRSS")) // 1024

    def fill(n: int) -> list[int]:
        at = [unsafe.allocateMemory(100_000) for _ in range(n)]
        for a in at:
            unsafe.setMemory(a, 100_000, 1)
        return at

    table = spark.range(10)
    written(table)
    before = resident()
    places = fill(3000)
    for a in places[:-1]:  # the last one keeps the C library from giving the rest back by itself
        unsafe.freeMemory(a)
    assert resident() > before + 200
    written(table)
    assert resident() < before + 150
    unsafe.freeMemory(places[-1])

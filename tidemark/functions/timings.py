"""Published timings of sorting record files, as input of the analytics queries."""

from __future__ import annotations

# File, workers, memory in MB, seconds of a task farm.
FARM = """
data/data_10M_p64.bin,1,512,12.7648
data/data_10M_p64.bin,2,512,6.98639
data/data_10M_p64.bin,4,512,5.24283
data/data_10M_p64.bin,8,512,4.53449
data/data_10M_p64.bin,16,512,4.91195
data/data_10M_p64.bin,32,512,5.12634
data/data_10M_p64.bin,64,512,5.36824
data/data_10M_p512.bin,1,2048,69.7561
data/data_10M_p512.bin,2,2048,27.9945
data/data_10M_p512.bin,4,2048,18.6089
data/data_10M_p512.bin,8,2048,15.7289
data/data_10M_p512.bin,16,2048,14.7253
data/data_10M_p512.bin,32,2048,13.2739
data/data_10M_p512.bin,64,2048,28.6809
data/data_50M_p64.bin,1,1024,126.611
data/data_50M_p64.bin,2,1024,94.4452
data/data_50M_p64.bin,4,1024,40.8751
data/data_50M_p64.bin,8,1024,29.6146
data/data_50M_p64.bin,16,1024,24.8425
data/data_50M_p64.bin,32,1024,27.8663
data/data_50M_p64.bin,64,1024,28.2874
data/data_50M_p512.bin,1,10240,994.54
data/data_50M_p512.bin,2,10240,404.188
data/data_50M_p512.bin,4,10240,388.39
data/data_50M_p512.bin,8,10240,212.45
data/data_50M_p512.bin,16,10240,256.115
data/data_50M_p512.bin,32,10240,249.033
data/data_50M_p512.bin,64,10240,360.534
"""

# File, seconds of one thread. One file was never timed alone.
SEQUENTIAL = """
data/data_10M_p64.bin,52.2425
data/data_10M_p512.bin,87.3384
data/data_50M_p64.bin,241.857
"""

# Processes, threads, seconds for data/data_10M_p64.bin.
GRID = """
1,16,6.77645
1,8,11.4693
1,4,18.0654
1,1,27.4718
2,16,15.0769
2,8,14.1326
2,4,16.939
2,1,21.9136
4,16,12.4804
4,8,10.5174
4,4,11.9663
4,1,12.9847
8,16,12.7928
8,8,10.4392
8,4,13.4428
8,1,11.9277
"""


def rows(text: str, *kinds) -> list[tuple]:
    return [tuple(k(x) for k, x in zip(kinds, line.split(","), strict=True)) for line in text.split()]


farm = rows(FARM, str, int, int, float)
sequential = rows(SEQUENTIAL, str, float)
grid = rows(GRID, int, int, float)

SELECT CAST(o.o_custkey AS STRING)   AS emplid,
       year(o.o_orderdate)           AS start_year,
       count(*)                      AS n_courses,
       sum(l.l_quantity)             AS total_quantity
FROM course_orders o
JOIN course_lines l ON l.l_orderkey = o.o_orderkey
GROUP BY o.o_custkey, year(o.o_orderdate)
